"""All queries of the analytics library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfin.plans import fundamental, further, market

QUERIES = market.QUERIES | fundamental.QUERIES | further.QUERIES
ORACLES = market.ORACLES | fundamental.ORACLES | further.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress-tested value at risk of each ticker."""
    return market.q_stress_scenarios(spark, sf_dir)
