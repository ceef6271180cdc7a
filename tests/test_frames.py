"""Moving quantiles against sorting each frame anew."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfin.functions import frames
from tallyfin.operators import risk


def brute(values, rows, level):
    out = []
    for i in range(len(values)):
        frame = values[max(0, i - rows) : i]
        out.append(float(np.quantile(frame, level)) if len(frame) == rows and not np.isnan(frame).any() else None)
    return out


@pytest.mark.parametrize("rows", [1, 2, 5, 60])
def test_moving_quantiles(rows):
    rng = np.random.default_rng(rows)
    values = np.round(rng.normal(size=400), 1)
    values[[37, 200]] = np.nan
    for level in (0.0, 0.05, 0.5, 1.0):
        for begin in (0, 3, 100):
            got = frames.moving_quantiles(values, begin, rows, level)
            want = brute(values, rows, level)[begin:]
            assert all((np.isnan(g) and w is None) or g == pytest.approx(w, abs=1e-12) for g, w in zip(got, want)) and len(got) == len(want)


@pytest.mark.parametrize("blocks", [1, 4, 37])
def test_rolling_value_at_risk_whatever_the_blocks(spark, blocks):
    rng = np.random.default_rng(3)
    series = {"long": 900, "short": 20, None: 130, **{f"k{i}": 1 + i * 7 for i in range(20)}}
    data = {k: [None if (k, i) == ("long", 400) else float(x) for i, x in enumerate(rng.normal(size=n))] for k, n in series.items()}
    df = spark.createDataFrame([(k, i, x) for k, xs in data.items() for i, x in enumerate(xs)], "ticker string, ts int, ret double").repartition(5)
    for rows in (50, 252):
        got = {(r.ticker, r.ts): r.var for r in risk.rolling_value_at_risk(df, rows, blocks=blocks).collect()}
        assert len(got) == sum(series.values())
        for k, xs in data.items():
            for i, q in enumerate(brute(np.array([np.nan if x is None else x for x in xs]), rows, 0.05)):
                assert got[k, i] == (None if q is None else pytest.approx(-q, abs=1e-12)), (k, i)


def test_long_frames_take_a_logarithm_more(spark):
    """A frame of 2520 rows over one series in many blocks; ten times the frame takes far less than ten times as long."""
    n = 30_000
    df = spark.range(n).select(F.lit("only").alias("ticker"), F.col("id").cast("int").alias("ts"), (F.sin(F.col("id") * 12.9898) * 0.05).alias("ret"))
    x = np.array([r.ret for r in df.orderBy("ts").collect()])
    found = risk.rolling_value_at_risk(df, 2520, blocks=12)
    got = {r.ts: r.var for r in found.filter("ts % 977 = 0").collect()}
    assert all(got[t] == (None if t < 2520 else pytest.approx(-np.quantile(x[t - 2520 : t], 0.05))) for t in got) and len(got) > 25
    assert found.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == 12
    times = []
    for rows in (252, 2520):
        start = time.perf_counter()
        frames.moving_quantiles(x, 0, rows, 0.05)
        times.append(time.perf_counter() - start)
    assert times[1] < 4 * times[0]


def test_frames_of_nothing_and_of_too_many_numbers(spark):
    df = spark.createDataFrame([], "ticker string, ts int, ret double")
    assert risk.rolling_value_at_risk(df, 5).count() == 0
    with pytest.raises(ValueError):
        risk.rolling_value_at_risk(df, 1 << 20, blocks=1000)
