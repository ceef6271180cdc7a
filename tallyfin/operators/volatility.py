"""Rolling and range-based volatility, and the parameters that a price model takes from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfin.functions import series as s

OHLC = ("open", "high", "low", "close")


def _ohlc() -> list[Column]:
    return [F.col(c) for c in OHLC]


def garman_klass(bars: DataFrame, windows: tuple[int, ...] = (30, 10, 5), order: str = "ts", keys: str = "ticker", periods_per_year: int | None = None) -> DataFrame:
    """(keys, order, gk_N...): root of the rolling mean term; annualised only on request."""
    w = s.ordered(keys, order)
    scale = F.sqrt(F.lit(float(periods_per_year))) if periods_per_year else F.lit(1.0)
    with_term = bars.withColumn("_term", s.garman_klass_term(*_ohlc()))
    root = lambda n: F.sqrt(F.greatest(F.lit(0.0), s.rolling_mean(F.col("_term"), w, n))) * scale
    return with_term.select(keys, order, *(F.when(s.rolling_mean(F.col("_term"), w, n).isNotNull(), root(n)).alias(f"gk_{n}") for n in windows))


def yang_zhang_weight(n: int) -> float:
    return 0.34 / (1.34 + (n + 1) / (n - 1))


def yang_zhang(bars: DataFrame, windows: tuple[tuple[int, int], ...] = ((5, 52), (10, 26)), order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, yz_N...) of (window, periods a year) pairs.

    The weight k stands on the Rogers-Satchell mean and 1 - k on the variance of close less open
    returns; both returns run from row to row.
    """
    w = s.ordered(keys, order)
    made = bars.select(
        keys, order, s.rogers_satchell_term(*_ohlc()).alias("_rs"), s.simple_return(F.col("open"), w).alias("_oo"), s.simple_return(F.col("close"), w).alias("_cc")
    ).withColumn("_co", F.col("_cc") - F.col("_oo"))

    def vol(n: int, periods: int) -> Column:
        k = yang_zhang_weight(n)
        variance = s.rolling_var(F.col("_oo"), w, n) + k * s.rolling_mean(F.col("_rs"), w, n) + (1 - k) * s.rolling_var(F.col("_co"), w, n)
        return F.when(variance >= 0, F.sqrt(variance * periods))

    return made.select(keys, order, *(vol(n, p).alias(f"yz_{n}") for n, p in windows))


def gbm_parameters(bars: DataFrame, window: int = 10, dt: float = 1 / 26, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, s0, mu, sigma, mu_literal): last price, mean log return over dt plus half the squared sigma, last Garman-Klass value.

    Last is the last that is known: bars of a price of nought have no term, and leave the windows that hold them without a value.
    A bar without a time stands after all others in the windows and is never the last that is known.
    mu_literal is the drift when the returns' mean is nil, which is what log returns that are aligned by their index come to.
    """
    w = s.ordered(keys, [F.col(order).asc_nulls_last()])
    made = bars.withColumns({"_lr": s.log_return(F.col("close"), w), "_term": s.garman_klass_term(*_ohlc())})
    made = made.withColumn("_gk", F.sqrt(s.rolling_mean(F.col("_term"), w, window)))
    last = made.groupBy(keys).agg(s.last_known(F.col("close"), order).alias("s0"), F.avg("_lr").alias("_m"), s.last_known(F.col("_gk"), order).alias("sigma"))
    half = 0.5 * F.col("sigma") * F.col("sigma")
    return last.select(keys, "s0", (F.col("_m") / dt + half).alias("mu"), "sigma", half.alias("mu_literal"))


def gbm_parameters_by(bars: DataFrame, volatility: DataFrame, column: str, dt: float, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, s0, mu, sigma) with the last known value of a volatility series as sigma; volatility: (keys, order, column)."""
    w = s.ordered(keys, order)
    base = bars.withColumn("_lr", s.log_return(F.col("close"), w)).groupBy(keys).agg(s.last_known(F.col("close"), order).alias("s0"), F.avg("_lr").alias("_m"))
    last = volatility.groupBy(keys).agg(s.last_known(F.col(column), order).alias("sigma"))
    return base.join(last, keys).select(keys, "s0", (F.col("_m") / dt + 0.5 * F.col("sigma") * F.col("sigma")).alias("mu"), "sigma")
