"""Further tests and measures that the analyses call for: residual and stationarity statistics, longer horizons, simulated and resampled risk, sentiment."""

from __future__ import annotations

from math import asin, exp, factorial, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.functions.series import ordered, simple_return
from tallyfin.operators.risk import check_confidence, historical


#: Cumulative probabilities of a Poisson(1) draw, as far as a double tells them from 1.
POISSON = tuple(p for k in range(30) if (p := sum(exp(-1) / factorial(j) for j in range(k + 1))) < 1 - 2**-53)


def differenced(df: DataFrame, value: str = "close", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, diff): first differences."""
    return df.select(keys, order, (F.col(value) - F.lag(value).over(ordered(keys, order))).alias("diff")).filter("diff is not null")


def detrended(df: DataFrame, value: str = "close", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, residual) about the least-squares line through the rows in order."""
    numbered = df.select(keys, order, F.col(value).alias("_y"), F.row_number().over(ordered(keys, order)).cast("double").alias("_x"))
    line = numbered.groupBy(keys).agg(F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"))
    return numbered.join(line, keys).select(keys, order, (F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x")).alias("residual"))


def durbin_watson(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, dw): squared successive differences of the values about their mean over their squares."""
    made = df.select(keys, order, (F.col(value) - F.avg(value).over(Window.partitionBy(keys))).alias("e"))
    made = made.withColumn("d", F.col("e") - F.lag("e").over(ordered(keys, order)))
    return made.groupBy(keys).agg(F.try_divide(F.sum(F.col("d") * F.col("d")), F.sum(F.col("e") * F.col("e"))).alias("dw"))


def arch_lm(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, lm): observations times the R squared of squared residuals on those before (one lag)."""
    made = df.select(keys, order, F.pow(F.col(value) - F.avg(value).over(Window.partitionBy(keys)), F.lit(2.0)).alias("y"))
    made = made.withColumn("x", F.lag("y").over(ordered(keys, order))).filter("x is not null")
    return made.groupBy(keys).agg(F.count("*").alias("n"), (F.count("*") * F.regr_r2("y", "x")).alias("lm"))


def kpss(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, kpss): the level statistic with the plain (lag 0) variance."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    made = df.select(keys, order, (F.col(value) - F.avg(value).over(Window.partitionBy(keys))).alias("e"))
    made = made.withColumn("s", F.sum("e").over(w))
    n = F.count("*")
    return made.groupBy(keys).agg(F.try_divide(F.sum(F.col("s") * F.col("s")), n * F.sum(F.col("e") * F.col("e"))).alias("kpss"))


#: Rows for which Royston's weights and p-values hold.
SHAPIRO_ROWS = (3, 5000)
#: Fixed values (Royston 1995), lowest power first: corrections of the two largest weights in 1 / sqrt(n), and mean and deviation of the transformed statistic for 4 to 11 rows (in n) and more (in ln n).
LARGEST, SECOND = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
FEW = ((-2.273, 0.459), (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322))
MANY = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def _powers(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, value: str = "ret", keys: str = "ticker") -> DataFrame:
    """(keys, n, w, p): Shapiro and Wilk's test of normality by Royston's weights, from the values' ranks within their key.

    Keys of under 3 or over 5000 values, for which the weights do not hold, and of equal values have null w and p, and their
    rows are not ranked; null values do not count.
    """
    sized = df.filter(F.col(value).isNotNull()).groupBy(keys).agg(F.count("*").alias("n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    fit = F.col("n").between(*SHAPIRO_ROWS) & (F.col("_low") < F.col("_high"))
    meant = sized.filter(fit).select(F.col(keys).alias("_key"), "n")
    rows = df.filter(F.col(value).isNotNull()).join(meant, F.col(keys).eqNullSafe(F.col("_key"))).select(keys, "n", F.col(value).cast("double").alias("x"))
    i = F.row_number().over(Window.partitionBy(keys).orderBy("x"))
    scored = rows.withColumn("m", normal.quantile_column((i - 0.375) / (F.col("n") + 0.25))).withColumn("_i", i)
    # the expected order statistics, their squares, and the two largest: m of n and n - 1
    last, second = F.max("m"), F.max(F.when(F.col("_i") == F.col("n") - 1, F.col("m")))
    ends = [F.max_by("x", "_i"), F.max(F.when(F.col("_i") == F.col("n") - 1, F.col("x"))), F.min_by("x", "_i"), F.max(F.when(F.col("_i") == 2, F.col("x")))]
    sums = scored.groupBy(keys, "n").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), last.alias("m1"), second.alias("m2"),
        *(e.alias(f"x{k}") for k, e in enumerate(ends)), (F.var_pop("x") * F.count("*")).alias("ss"),
    )
    u, root = 1 / F.sqrt("n"), F.sqrt("mm")
    a1 = F.when(F.col("n") == 3, 0.5**0.5).otherwise(_powers(LARGEST, u) + F.col("m1") / root)
    a2 = _powers(SECOND, u) + F.col("m2") / root
    made = sums.select("*", a1.alias("a1"), F.when(F.col("n") > 5, a2).alias("a2"))
    outer = F.col("a1") * (F.col("x0") - F.col("x2")) + F.coalesce(F.col("a2") * (F.col("x1") - F.col("x3")), F.lit(0.0))
    two = F.col("n") > 5
    phi = (F.col("mm") - 2 * F.col("m1") * F.col("m1") - F.when(two, 2 * F.col("m2") * F.col("m2")).otherwise(0.0)) / (1 - 2 * F.col("a1") * F.col("a1") - F.when(two, 2 * F.col("a2") * F.col("a2")).otherwise(0.0))
    inner = F.col("mx") - F.col("m1") * (F.col("x0") - F.col("x2")) - F.when(two, F.col("m2") * (F.col("x1") - F.col("x3"))).otherwise(0.0)
    weighed = F.when(F.col("n") == 3, outer).otherwise(outer + inner / F.sqrt(phi))
    w = F.least(F.lit(1.0), weighed * weighed / F.col("ss"))
    found = made.select(keys, "n", w.alias("w"))
    n, y, left = F.col("n").cast("double"), F.ln("n"), F.greatest(1 - F.col("w"), F.lit(1e-19))
    few = (-F.ln(_powers(FEW[0], n) - F.ln(left)) - _powers(FEW[1], n)) / F.exp(_powers(FEW[2], n))
    many = (F.ln(left) - _powers(MANY[0], y)) / F.exp(_powers(MANY[1], y))
    three = F.greatest(F.lit(0.0), 6 / pi * (F.asin(F.sqrt("w")) - asin(0.75**0.5)))
    p = F.when(F.col("n") == 3, three).when((F.col("n") <= 11) & (_powers(FEW[0], n) <= F.ln(left)), 0.0).when(F.col("n") <= 11, normal.upper_tail(few)).otherwise(normal.upper_tail(many))
    return found.select(keys, "n", "w", p.alias("p")).unionByName(sized.filter(~fit).select(keys, "n", F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("p")))


def horizon_risk(rets: DataFrame, days: int, confidence: float = 0.95, keys: str = "ticker") -> DataFrame:
    """Daily figures scaled by the root of the horizon."""
    base = historical(rets, confidence, (keys,))
    return base.select(keys, *((F.col(c) * F.sqrt(F.lit(float(days)))).alias(c) for c in ("var", "cvar")))


def simulated_risk(rets: DataFrame, draws: int = 5000, confidence: float = 0.95, keys: str = "ticker") -> DataFrame:
    """Historical figures of normal draws with each key's mean and deviation."""
    fit = rets.groupBy(keys).agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"))
    drawn = fit.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return historical(drawn.select(keys, (F.col("mu") + F.col("sd") * normal.normal(keys, "draw")).alias("ret")), confidence, (keys,))


def bootstrap_cvar(rets: DataFrame, samples: int = 100, confidence: float = 0.95, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, mean_cvar, std_cvar) over resamples with replacement.

    A row's weight in a sample is a Poisson(1) draw of its key, so no sample is gathered: every row
    emits its weighted copies, and samples are grouped like any key.
    """
    check_confidence(confidence)
    u = normal.uniform(F.lit("boot"), keys, order, "sample")
    weight = F.lit(0)
    for p in POISSON:
        weight = weight + F.when(u >= p, 1).otherwise(0)
    drawn = rets.select(keys, order, "ret", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    copies = drawn.withColumn("w", weight).filter("w > 0").select(keys, "sample", F.explode(F.array_repeat("ret", F.col("w"))).alias("ret"))
    return historical(copies, confidence, (keys, "sample")).groupBy(keys).agg(F.avg("cvar").alias("mean_cvar"), F.stddev_samp("cvar").alias("std_cvar"))


def sentiment_features(scores: DataFrame, window: int = 5, lags: tuple[int, ...] = (1, 2), order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, score, moving, ratio, score_lag...): rolling mean, positives over negatives in the window, and earlier scores."""
    w = ordered(keys, order)
    frame = w.rowsBetween(-(window - 1), 0)
    positive, negative = (F.sum(F.when(c, 1).otherwise(0)).over(frame) for c in (F.col("score") > 0, F.col("score") < 0))
    moving = F.when(F.count("score").over(frame) >= window, F.avg("score").over(frame))
    return scores.select(keys, order, "score", moving.alias("moving"), F.try_divide(positive, negative).alias("ratio"), *(F.lag("score", k).over(w).alias(f"score_lag{k}") for k in lags))


def breusch_pagan(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, lm): observations times the R squared of squared residuals on the value before; residuals are of the line on that value."""
    made = df.select(keys, order, F.col(value).alias("y")).withColumn("x", F.lag("y").over(ordered(keys, order))).filter("x is not null")
    line = made.groupBy(keys).agg(F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"))
    squared = made.join(line, keys).withColumn("e2", F.pow(F.col("y") - F.col("_a") - F.col("_b") * F.col("x"), F.lit(2.0)))
    return squared.groupBy(keys).agg(F.count("*").alias("n"), (F.count("*") * F.regr_r2("e2", "x")).alias("lm"))


def phillips_perron(df: DataFrame, lags: int = 5, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, t): the Dickey-Fuller t with a constant, corrected by the long-run variance of the residuals (Bartlett weights)."""
    made = df.select(keys, order, F.col(value).alias("y")).withColumn("x", F.lag("y").over(ordered(keys, order))).filter("x is not null")
    fit = made.groupBy(keys).agg(F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"), F.regr_sxx("y", "x").alias("_sxx"), F.count("*").alias("n"))
    resid = made.join(fit, keys).withColumn("u", F.col("y") - F.col("_a") - F.col("_b") * F.col("x"))
    w = ordered(keys, order)
    products = resid.select(keys, "_b", "_sxx", "n", "u", *((F.col("u") * F.lag("u", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)))
    sums = products.groupBy(keys, "_b", "_sxx", "n").agg(F.sum(F.col("u") * F.col("u")).alias("_uu"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"_{k}") for k in range(1, lags + 1)))
    short = F.col("_uu") / F.col("n")
    long = short
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.col(f"_{k}") / F.col("n")
    s2 = F.col("_uu") / (F.col("n") - 2)
    error = F.sqrt(s2 / F.col("_sxx"))
    n = F.col("n").cast("double")
    t = (F.col("_b") - 1) / error * F.sqrt(short / long) - (long - short) * n * error / (2 * F.sqrt(long) * F.sqrt(s2))
    return sums.select(keys, "n", t.alias("t"))


def seasonally_adjusted(df: DataFrame, season: Column, value: str = "close", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, adjusted): the value less its season's mean, plus the series' mean."""
    of_season, whole = Window.partitionBy(keys, "_season"), Window.partitionBy(keys)
    made = df.select(keys, order, F.col(value).alias("_y"), season.alias("_season"))
    return made.select(keys, order, (F.col("_y") - F.avg("_y").over(of_season) + F.avg("_y").over(whole)).alias("adjusted"))


def illiquidity(bars: DataFrame, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, days, illiquidity): the mean of absolute returns over the money traded (close times volume)."""
    ret = F.abs(simple_return(F.col("close"), ordered(keys, order)))
    made = bars.select(keys, F.try_divide(ret, F.col("close") * F.col("volume")).alias("i")).filter("i is not null")
    return made.groupBy(keys).agg(F.count("*").alias("days"), F.avg("i").alias("illiquidity"))


def factor_exposure(rets: DataFrame, factor: DataFrame, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, alpha, beta, r2, specific): returns on a factor's at the same times, and the deviation that it leaves unexplained.  factor: (order, ret)."""
    met = rets.select(keys, order, F.col("ret").alias("y")).join(factor.select(order, F.col("ret").alias("x")), order)
    fit = met.groupBy(keys).agg(F.count("*").alias("n"), F.regr_intercept("y", "x").alias("alpha"), F.regr_slope("y", "x").alias("beta"), F.regr_r2("y", "x").alias("r2"), F.stddev_samp("y").alias("_sd"))
    return fit.select(keys, "n", "alpha", "beta", "r2", (F.col("_sd") * F.sqrt(1 - F.col("r2"))).alias("specific"))


def tail_index(rets: DataFrame, share: float = 0.1, keys: str = "ticker") -> DataFrame:
    """(keys, threshold, n, hill, mean_excess): losses over the quantile of ``share``: Hill's index (of positive thresholds) and the mean excess."""
    losses = rets.select(keys, (-F.col("ret")).alias("loss")).withColumn("threshold", F.percentile("loss", F.lit(1 - share)).over(Window.partitionBy(keys)))
    over = losses.filter(F.col("loss") > F.col("threshold"))
    index = F.try_divide(F.lit(1.0), F.avg(F.when(F.col("threshold") > 0, F.ln(F.col("loss") / F.col("threshold")))))
    return over.groupBy(keys, "threshold").agg(F.count("*").alias("n"), index.alias("hill"), F.avg(F.col("loss") - F.col("threshold")).alias("mean_excess"))
