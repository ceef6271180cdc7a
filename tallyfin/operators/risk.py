"""Value at risk, expected shortfall, stress scenarios, portfolios, back-tests and the report's lines."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfin.functions import normal
from tallyfin.functions.frames import rolling_quantile
from tallyfin.functions.quantile import exact_quantiles
from tallyfin.functions.series import annualised, ordered, simple_return
from tallyfin.schema import SCENARIOS
from tallyfin.session import checkpoint, small


@dataclass(frozen=True)
class Scenario:
    """A shift of returns, then a multiplier, then a constant in the last rows."""

    scenario: str
    shock: float | None = None
    vol_mult: float | None = None
    tail_days: int | None = None
    tail_return: float | None = None


#: The default stress scenarios.
DEFAULT_SCENARIOS = (
    Scenario("Market Crash", shock=-0.10),
    Scenario("High Volatility", vol_mult=2.0),
    Scenario("Prolonged Decline", tail_days=30, tail_return=-0.02),
    Scenario("Mixed Scenario", shock=-0.05, vol_mult=1.5),
)


def check_confidence(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must lie between 0 and 1, not {confidence}")
    return confidence


def returns(prices: DataFrame, price: str = "close", order: str = "ts", keys: str = "ticker", periods_per_year: int | None = None) -> DataFrame:
    """(keys, order, ret) of successive rows; rows without a return are left out."""
    ret = simple_return(F.col(price), ordered(keys, order))
    if periods_per_year:
        ret = annualised(ret, periods_per_year)
    return prices.select(keys, order, ret.alias("ret")).filter("ret is not null")


def look_back(series: DataFrame, days: int = 365, order: str = "date", keys: str = "ticker") -> DataFrame:
    """Rows from ``days`` before each key's last date on, that moment included.

    Prices are cut, and returns taken of what is left, so that no return reaches back to a price before the window.
    """
    last = series.groupBy(keys).agg(F.max(order).alias("_last"))
    return series.join(last, keys).filter(F.col(order) >= F.col("_last") - F.expr(f"interval {int(days)} days")).select(*series.columns)


def historical(rets: DataFrame, confidence: float = 0.95, keys: tuple[str, ...] = ("ticker",), value: str = "ret", approximate: bool = False) -> DataFrame:
    """(keys, var, cvar): the loss at the quantile and the mean loss at or beyond it.

    The exact quantile comes from counts by digit (``functions.quantile``), so a key may have any number
    of returns and none is a single task's.  With ``approximate`` it is a sketch's, in one pass.
    """
    level = 1 - check_confidence(confidence)
    if approximate:
        cut = rets.groupBy(*keys).agg(F.percentile_approx(value, F.lit(level), 100_000).alias("_q"))
        tail = rets.join(cut, list(keys))
        return tail.filter(F.col(value) <= F.col("_q")).groupBy(*keys).agg((-F.first("_q")).alias("var"), (-F.avg(value)).alias("cvar"))
    return historical_at(rets, (confidence,), keys, value).select(*keys, "var", "cvar")


def historical_at(rets: DataFrame, confidences: tuple[float, ...], keys: tuple[str, ...] = ("ticker",), value: str = "ret") -> DataFrame:
    """(keys, var, cvar, confidence) at several confidences, from the same passes."""
    levels = [1 - check_confidence(c) for c in confidences]
    rows = checkpoint(rets.select(*keys, F.col(value).cast("double").alias("_v")))
    cut = checkpoint(exact_quantiles(rows, "_v", levels, keys).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("q").alias("_q")))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    tails = rows.join(small(cut), same & (F.col("_v") <= F.array_max("_q")))
    means = (F.avg(F.when(F.col("_v") <= F.col("_q")[i], F.col("_v"))).alias(f"_{i}") for i in range(len(levels)))
    sums = tails.groupBy(*keys, "_q").agg(*means)
    found = F.array(*(F.struct((-F.col("_q")[i]).alias("var"), (-F.col(f"_{i}")).alias("cvar"), F.lit(c).alias("confidence")) for i, c in enumerate(confidences)))
    return sums.select(*keys, F.explode(found).alias("_r")).select(*keys, "_r.*")


def parametric(rets: DataFrame, confidence: float = 0.95, keys: tuple[str, ...] = ("ticker",), value: str = "ret") -> DataFrame:
    """(keys, var, cvar, cvar_textbook) of a normal fit; cvar has the sign that the screened scripts give it, cvar_textbook the loss."""
    z = normal.quantile(1 - check_confidence(confidence))
    density = normal.standard_density(z) / (1 - confidence)
    fit = rets.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    return fit.select(*keys, (-(F.col("mu") + z * F.col("sd"))).alias("var"), (-(F.col("mu") + F.col("sd") * density)).alias("cvar"), (-F.col("mu") + F.col("sd") * density).alias("cvar_textbook"))


def literal(s: Scenario) -> Column:
    """A scenario as a struct of SCENARIOS' columns."""
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(astuple(s), T.StructType.fromDDL(SCENARIOS))))


def scenario_table(spark: SparkSession, scenarios: tuple[Scenario, ...] = DEFAULT_SCENARIOS) -> DataFrame:
    return spark.createDataFrame([astuple(s) for s in scenarios], SCENARIOS)


def stressed(rets: DataFrame, scenarios: tuple[Scenario, ...] = DEFAULT_SCENARIOS, order: str = "ts", keys: str = "ticker", value: str = "ret") -> DataFrame:
    """(keys, scenario, ret): every return under every scenario, from one pass over the returns.

    Scenarios are literals in the plan (their number is the caller's tuple), so no table is joined.
    """
    latest = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))

    def under(s: Scenario) -> Column:
        r = F.col(value)
        if s.shock is not None:
            r = r + s.shock
        if s.vol_mult is not None:
            r = r * s.vol_mult
        if s.tail_days is not None:
            r = F.when(F.col("_latest") <= s.tail_days, F.lit(s.tail_return)).otherwise(r)
        return F.struct(F.lit(s.scenario).alias("scenario"), r.alias("ret"))

    ranked = rets.withColumn("_latest", latest)
    return ranked.select(keys, F.explode(F.array(*map(under, scenarios))).alias("s")).select(keys, "s.scenario", F.col("s.ret").alias("ret"))


def stress_test(rets: DataFrame, scenarios: tuple[Scenario, ...] = DEFAULT_SCENARIOS, confidence: float = 0.95, order: str = "ts") -> DataFrame:
    return historical(stressed(rets, scenarios, order), confidence, ("ticker", "scenario"))


def portfolio(rets: DataFrame, order: str = "ts", name: str = "PORTFOLIO") -> DataFrame:
    """(ticker, order, ret): the mean return of whatever is priced at each time."""
    return rets.groupBy(order).agg(F.avg("ret").alias("ret")).select(F.lit(name).alias("ticker"), order, "ret")


def rolling_value_at_risk(rets: DataFrame, rows: int, confidence: float = 0.95, order: str = "ts", keys: str = "ticker", blocks: int | None = None) -> DataFrame:
    """(keys, order, ret, var): the historical loss quantile of the ``rows`` rows before each, null where they are not as many values.

    The frame's order statistic is kept as it moves (``functions.frames``), so frames may be long, and a
    series is dealt to many tasks.
    """
    found = rolling_quantile(rets, "ret", rows, 1 - check_confidence(confidence), [keys], [order], "_q", blocks)
    return found.select(keys, order, "ret", (-F.col("_q")).alias("var"))


def back_test(rets: DataFrame, rows: int, confidence: float = 0.95, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, days, breaches, expected): how often the loss passed the value at risk of the rows before."""
    rolled = rolling_value_at_risk(rets, rows, confidence, order, keys).filter("var is not null")
    breach = F.sum(F.when(F.col("ret") < -F.col("var"), 1).otherwise(0))
    return rolled.groupBy(keys).agg(F.count("*").alias("days"), breach.alias("breaches"), (F.count("*") * (1 - confidence)).alias("expected"))


def report_lines(base: DataFrame, stress: DataFrame, portfolio_name: str = "PORTFOLIO", confidence: float = 0.95) -> DataFrame:
    """(section, ticker, scenario, line): the report's figures with four decimals, portfolio first.

    base: (ticker, var, cvar); stress: (ticker, scenario, var, cvar).
    """
    figures = base.select("ticker", F.lit("").alias("scenario"), "var", "cvar").unionByName(stress.select("ticker", "scenario", "var", "cvar"))
    percent = f"{confidence:.0%}"
    text = F.format_string(f"VaR ({percent}): %.4f  cVaR ({percent}): %.4f".replace("%)", "%%)"), "var", "cvar")
    section = F.when(F.col("ticker") == portfolio_name, 0).otherwise(1)
    return figures.select(section.alias("section"), "ticker", "scenario", text.alias("line"))


def report_document(lines: DataFrame) -> DataFrame:
    """(ticker, text): each ticker's figures as one text, its own first and scenarios in order of name."""
    ordered_lines = F.array_sort(F.collect_list(F.struct("scenario", "line")))
    shown = F.transform(ordered_lines, lambda x: F.when(x["scenario"] == "", x["line"]).otherwise(F.concat(F.lit("  "), x["scenario"], F.lit(": "), x["line"])))
    return lines.groupBy("section", "ticker").agg(shown.alias("shown")).select("section", "ticker", F.concat(F.col("ticker"), F.lit(":\n"), F.array_join("shown", "\n")).alias("text"))
