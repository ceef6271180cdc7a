"""Correlations of past volatility with the return that follows, over a grid of windows and horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.functions import series as s

#: The grid.
WINDOWS, HORIZONS = tuple(range(3, 15)), tuple(range(1, 15))


def correlation_grid(prices: DataFrame, windows: tuple[int, ...] = WINDOWS, horizons: tuple[int, ...] = HORIZONS, price: str = "close", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, window, days, corr) for every cell.

    All rolling deviations and forward returns share one sort; only the windows are unpivoted, and
    each group takes one correlation per horizon, so rows grow by the number of windows and no more.
    """
    w = s.ordered(keys, order)
    wide = prices.select(
        keys, *(s.rolling_std(F.col(price), w, n).alias(f"std_{n}") for n in windows), *(s.forward_return(F.col(price), w, d).alias(f"fwd_{d}") for d in horizons)
    )
    long = wide.unpivot([keys, *(f"fwd_{d}" for d in horizons)], [f"std_{n}" for n in windows], "_name", "_std")
    cells = long.groupBy(keys, F.substring_index("_name", "_", -1).cast("int").alias("window")).agg(*(F.corr("_std", f"fwd_{d}").alias(f"{d}") for d in horizons))
    out = cells.unpivot([keys, "window"], [f"{d}" for d in horizons], "days", "corr")
    return out.select(keys, "window", F.col("days").cast("int").alias("days"), "corr")


def best_cell(grid: DataFrame, keys: str = "ticker") -> DataFrame:
    """The cell of the largest correlation of each key; the first by window and horizon of equals."""
    order = Window.partitionBy(keys).orderBy(F.desc_nulls_last("corr"), "window", "days")
    return grid.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def window_means(grid: DataFrame, keys: str = "ticker") -> DataFrame:
    return grid.groupBy(keys, "window").agg(F.avg("corr").alias("mean_corr"))


def matrix(grid: DataFrame, horizons: tuple[int, ...] = HORIZONS, keys: str = "ticker") -> DataFrame:
    """The grid as a heat map's matrix: a column for each horizon."""
    return grid.groupBy(keys, "window").pivot("days", list(horizons)).agg(F.first("corr"))
