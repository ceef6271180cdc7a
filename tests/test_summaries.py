"""Merged summaries against exact quantiles, by rank."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfin.operators import summaries

DAY = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rets(spark):
    rng = np.random.default_rng(2)
    rows = [(k, DAY + dt.timedelta(days=int(d), minutes=int(m)), float(x)) for k, n in (("a", 9000), ("b", 40), (None, 300)) for d, m, x in zip(rng.integers(0, 12, n), rng.integers(0, 1440, n), rng.normal(0, 0.01, n))]
    rows += [("b", DAY, None), ("gap", DAY, 0.5), ("gap", DAY + dt.timedelta(days=9), 0.25), ("b", None, 3.0)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, ret double").repartition(4).cache()


@pytest.mark.parametrize("days", [1, 5, 30])
def test_ranks_are_within_the_bound(rets, days):
    found = summaries.value_at_risk(summaries.daily(rets), days)
    got = summaries.ranked(found, rets, days, 0.05).collect()
    exact = {}
    for r in rets.filter("ret is not null and ts is not null").collect():
        for j in range(days):
            exact.setdefault((r.ticker, r.ts.date() + dt.timedelta(j)), []).append(r.ret)
    assert len(got) == found.count() and {(r.ticker, r.day) for r in got} <= set(exact)
    for r in got:
        assert r.n == len(exact[r.ticker, r.day])
        assert r.rank_low - 3 * summaries.rank_error() <= 0.05 <= r.rank_high + 3 * summaries.rank_error() + 1 / r.n


def test_summaries_are_stored_by_day_and_read_by_day(spark, rets, tmp_path):
    folder = str(tmp_path / "kept")
    made = summaries.daily(rets)
    summaries.store(made.filter("day < '2024-03-06'"), folder)
    summaries.store(made.filter("day >= '2024-03-05'"), folder)  # one day again
    kept = summaries.stored(spark, folder)
    assert kept.count() == made.count() and kept.agg(F.sum("n")).first()[0] == made.agg(F.sum("n")).first()[0]
    late = summaries.stored(spark, folder, "2024-03-09")
    assert late.agg(F.min("day")).first()[0] == dt.date(2024, 3, 9) and "PartitionFilters: [isnotnull(day" in late._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert summaries.value_at_risk(late, 3).count() > 0


def test_summaries_of_nothing(rets):
    assert summaries.value_at_risk(summaries.daily(rets.limit(0)), 5).count() == 0
