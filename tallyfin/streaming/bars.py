"""Structured Streaming over the event stream: bars in windows, sessions, and running volatility (beyond the screened scripts)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EWMA_OUT = "ticker string, n long, value double, variance double"
EWMA_STATE = "n long, last double, variance double"


def read_events(spark: SparkSession, path: str, pattern: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The events of a folder's files as they arrive."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_bars(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(ticker, start, open, high, low, close, volume) of tumbling or sliding windows; later events than ``late`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    bars = events.withWatermark("ts", late).groupBy(F.col("event_type").alias("ticker"), w.alias("w")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("volume")
    )
    return bars.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of a user's events with no longer pause than the gap."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_volatility(events: DataFrame, decay: float = 0.94) -> DataFrame:
    """(ticker, n, value, variance) after each batch: exponentially weighted variance of the returns between successive values, with three numbers of state a ticker."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, last, variance = state.get if state.exists else (0, float("nan"), 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for value in rows["value"]:
            if n and last:
                variance = decay * variance + (1 - decay) * (value / last - 1) ** 2
            n, last = n + 1, value
        state.update((n, last, variance))
        yield pd.DataFrame([[key[0], n, last, variance]], columns=["ticker", "n", "value", "variance"])

    keyed = events.select(F.col("event_type").alias("ticker"), "ts", "event_id", "value")
    return keyed.groupBy("ticker").applyInPandasWithState(update, EWMA_OUT, EWMA_STATE, "update", "NoTimeout")
