"""Quantile summaries kept by key and day, and merged over any look-back: values are read once, whatever is asked later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of a sketch: an estimate's rank is off by ``rank_error(k)`` of all values at most, with 99 % confidence.
K = 400


def rank_error(k: int = K) -> float:
    """The bound that the sketches' authors publish for a single quantile."""
    return 2.296 / k**0.9021


def daily(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker", k: int = K) -> DataFrame:
    """(keys, day, n, sketch): a summary of each key's values of a day.  Null values do not count, and days of none have no row; partially aggregated, so a hot key is a few sketches a task."""
    told = df.filter(F.col(value).isNotNull() & F.col(order).isNotNull())
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))
    return told.groupBy(keys, F.to_date(order).alias("day")).agg(F.count("*").alias("n"), sketch.alias("sketch"))


def store(summaries: DataFrame, folder: str) -> None:
    """Add days to a folder of summaries, one folder a day; a day that is written again replaces what was there."""
    summaries.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def stored(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The summaries of a folder, of days from ``since`` on; other days are not read."""
    df = spark.read.parquet(folder)
    return df.filter(F.col("day") >= F.to_date(F.lit(since))) if since else df


def look_back(summaries: DataFrame, days: int, keys: str = "ticker") -> DataFrame:
    """(keys, day, n, sketch): for each day that has a summary, those of the ``days`` days up to it as one.

    A day's sketch meets the days that look back on it (``days`` of them at most, of those that the key has), and is merged by partial aggregation.
    """
    ahead = Window.partitionBy(keys).orderBy(F.unix_date("day")).rangeBetween(0, days - 1)
    met = summaries.withColumn("days", F.collect_set("day").over(ahead)).withColumn("to", F.explode("days"))
    merged = met.groupBy(keys, F.col("to").alias("day")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(keys, "day", "n", "sketch")


def quantile(sketch: Column | str, level: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(level))


def value_at_risk(summaries: DataFrame, days: int, confidence: float = 0.95, keys: str = "ticker") -> DataFrame:
    """(keys, day, n, var): the loss quantile of the ``days`` days up to each, from their summaries alone."""
    found = look_back(summaries, days, keys)
    return found.select(keys, "day", "n", (-quantile("sketch", 1 - confidence)).alias("var"))


def ranked(estimates: DataFrame, df: DataFrame, days: int, level: float, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """Estimates with rank_low and rank_high: the shares of the look-back's values under and up to the estimate, counted exactly; ``level`` should lie between them but for the bound."""
    told = df.filter(F.col(value).isNotNull()).select(F.col(keys).alias("_k"), F.to_date(order).alias("_day"), F.col(value).alias("_v"))
    spread = told.withColumn("_to", F.explode(F.sequence("_day", F.date_add("_day", days - 1))))
    met = estimates.join(spread, F.col(keys).eqNullSafe(F.col("_k")) & (F.col("day") == F.col("_to")))
    under, upto = F.avg((F.col("_v") < -F.col("var")).cast("int")), F.avg((F.col("_v") <= -F.col("var")).cast("int"))
    return met.groupBy(*estimates.columns).agg(under.alias("rank_low"), upto.alias("rank_high"))
