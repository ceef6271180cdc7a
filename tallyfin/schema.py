"""Schemas, and checks and clean-up of column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICES = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("adj_close", T.DoubleType()), T.StructField("volume", T.LongType()),
])
SCENARIOS = "scenario string, shock double, vol_mult double, tail_days int, tail_return double"


class MissingColumns(ValueError):
    """Required columns that a table lacks."""


def validate_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    """The table itself; raises MissingColumns if it lacks any required column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def canonical_name(header: str) -> str:
    """Lower case with underscores; without byte-order marks and any white space at the ends."""
    return re.sub(r"\s+", "_", re.sub("^[\\s\ufeff]+|[\\s\ufeff]+$", "", header)).lower()


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(canonical_name(c) for c in df.columns))
