"""Simulated paths and valuations with draws that their key alone decides, so any engine and any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.functions.scan import scan


def _paths(models: DataFrame, paths: int, keys: str = "ticker", name: str = "path") -> DataFrame:
    """Each model's row for each path number from 0, dealt to all tasks: a few small rows become much work, which their size does not tell."""
    parts = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return models.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition(parts, keys, name)


def gbm_paths(models: DataFrame, horizon: float = 0.5, dt: float = 1 / 26, paths: int = 1000, keys: str = "ticker", logs: bool = False) -> DataFrame:
    """(keys, path, step, price) of geometric Brownian motion; models: (keys, s0, mu, sigma).

    Time runs in equal parts from 0 to the horizon while the Wiener process already has one increment
    at the first step, so step 0 is not s0.  With ``logs`` the last column is log_price, which no volatility takes out of range.
    """
    n = int(horizon / dt)
    grid = _paths(models, paths, keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy(keys, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    wiener = F.sum(normal.normal(keys, "path", "step") * F.sqrt(F.lit(dt))).over(w)
    t = F.col("step") * (horizon / (n - 1) if n > 1 else 0.0)
    drift = (F.col("mu") - 0.5 * F.col("sigma") * F.col("sigma")) * t
    moved = drift + F.col("sigma") * wiener
    return grid.select(keys, "path", "step", (F.ln("s0") + moved).alias("log_price") if logs else (F.col("s0") * F.exp(moved)).alias("price"))


def mean_path(paths: DataFrame, keys: str = "ticker") -> DataFrame:
    return paths.groupBy(keys, "step").agg(F.avg("price").alias("mean_price"))


def final_statistics(paths: DataFrame, keys: str = "ticker") -> DataFrame:
    """Mean, median, 5th and 95th percentile of the last step's prices; a null key is a key like any other."""
    ends = paths.groupBy(F.col(keys).alias("_key")).agg(F.max("step").alias("_last"))
    last = paths.join(ends, F.col(keys).eqNullSafe(F.col("_key")) & (F.col("step") == F.col("_last")), "left_semi")
    return summary(last, "price", keys)


def summary(df: DataFrame, value: str, keys: str = "ticker") -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p.alias("p"))
    return out.select(keys, "mean", F.col("p")[1].alias("median"), "std", F.col("p")[0].alias("p5"), F.col("p")[2].alias("p95"))


def ou_paths(models: DataFrame, horizon: float = 1.0, dt: float = 1 / 252, paths: int = 1000, keys: str = "ticker") -> DataFrame:
    """(keys, path, x, x_final): a mean-reverting path by Euler steps, folded within its row; models: (keys, x0, mu, sigma, theta)."""
    n = int(horizon / dt)
    drawn = _paths(models, paths, keys)
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: normal.normal(keys, "path", i))
    step = lambda x, z: x + F.col("theta") * (F.col("mu") - x) * dt + F.col("sigma") * F.sqrt(F.lit(dt)) * z
    x0 = F.col("x0").cast("double")
    drawn = drawn.select(keys, "path", x0.alias("x0"), "mu", "sigma", "theta", steps.alias("steps"))
    out = drawn.select(keys, "path", scan(F.col("steps"), F.col("x0"), step).alias("x"))
    return out.withColumn("x_final", F.element_at("x", -1))


def ou_final(models: DataFrame, horizon: float = 1.0, dt: float = 1 / 252, paths: int = 1000, keys: str = "ticker") -> DataFrame:
    """(keys, path, x_final) only: the fold keeps one number instead of the path."""
    n = int(horizon / dt)
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: normal.normal(keys, "path", i))
    step = lambda x, z: x + F.col("theta") * (F.col("mu") - x) * dt + F.col("sigma") * F.sqrt(F.lit(dt)) * z
    return _paths(models, paths, keys).select(keys, "path", F.aggregate(steps, F.col("x0").cast("double"), step).alias("x_final"))


def dcf_draws(companies: DataFrame, draws: int = 10_000, years: int = 5, keys: str = "company") -> DataFrame:
    """(keys, draw, wacc, terminal_growth, fcf_growth, pv_fcf, pv_terminal, price, invalid).

    companies: (keys, fcf, wacc, terminal_growth, debt, cash, shares).  WACC is uniform in 0.8 to 1.2
    of its value, terminal growth from 0.5 of its value to the lesser of 1.5 of it and 0.9 WACC, cash
    flow growth from 2 to 10 %.  ``invalid`` marks draws whose growth reaches the WACC.
    """
    between = lambda low, high, name: low + (high - low) * normal.uniform(F.lit(name), keys, "draw")
    base = _paths(companies.withColumnsRenamed({"wacc": "_w", "terminal_growth": "_g"}), draws, keys, "draw")
    drawn = base.withColumns({
        "wacc": between(0.8 * F.col("_w"), 1.2 * F.col("_w"), "wacc"),
        "terminal_growth": between(0.5 * F.col("_g"), F.least(1.5 * F.col("_g"), 0.9 * F.col("_w")), "growth"),
        "fcf_growth": between(F.lit(0.02), F.lit(0.1), "fcf"),
    })
    return valued(drawn, years).select(keys, "draw", "wacc", "terminal_growth", "fcf_growth", "pv_fcf", "pv_terminal", "price", (F.col("terminal_growth") >= F.col("wacc")).alias("invalid"))


def valued(df: DataFrame, years: int = 5) -> DataFrame:
    """Adds pv_fcf, pv_terminal, enterprise value and price; df: (fcf, fcf_growth, wacc, terminal_growth, debt, cash, shares)."""
    ratio = (1 + F.col("fcf_growth")) / (1 + F.col("wacc"))
    discounted: Column = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda s, i: s + F.col("fcf") * F.pow(ratio, i.cast("double")))
    last = F.col("fcf") * F.pow(1 + F.col("fcf_growth"), F.lit(float(years)))
    terminal = F.try_divide(last * (1 + F.col("terminal_growth")), F.col("wacc") - F.col("terminal_growth")) / F.pow(1 + F.col("wacc"), F.lit(float(years)))
    out = df.withColumns({"pv_fcf": discounted, "pv_terminal": terminal})
    out = out.withColumn("enterprise_value", F.col("pv_fcf") + F.col("pv_terminal"))
    return out.withColumn("price", F.try_divide(F.col("enterprise_value") - F.col("debt") + F.col("cash"), F.col("shares")))


def histogram(df: DataFrame, value: str, bins: int = 20, keys: str = "ticker") -> DataFrame:
    """(keys, bin, lower, upper, n): equal bins from the least to the largest value, the last closed; null values, and those of a key that has one value only, count in the last."""
    ends = df.groupBy(keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width).cast("int"))).otherwise(bins - 1)
    counted = df.join(ends, keys).groupBy(keys, at.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return counted.select(keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "n")


def kernel_density(df: DataFrame, value: str, points: int = 50, keys: str = "ticker") -> DataFrame:
    """(keys, x, density): a Gaussian kernel estimate with Scott's width on a grid from the least to the largest value.

    Each point is a sum of its own, partially aggregated, so a value stays one row however many points there are.
    """
    fit = df.groupBy(keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    x = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (points - 1)
    met = df.join(fit, keys).select(keys, F.col(value).alias("_v"), "_lo", "_hi", "_n", h.alias("_h"))
    sums = met.groupBy(keys, "_lo", "_hi", "_n").agg(*(F.sum(normal.density(x(i), F.col("_v"), F.col("_h"))).alias(f"_{i}") for i in range(points)))
    rows = F.array(*(F.struct(x(i).alias("x"), (F.col(f"_{i}") / F.col("_n")).alias("density")) for i in range(points)))
    return sums.select(keys, F.explode(rows).alias("r")).select(keys, "r.*")
