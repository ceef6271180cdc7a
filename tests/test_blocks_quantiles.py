"""Recursions in blocks against plain folds, and quantiles by digits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfin.functions import blocks
from tallyfin.functions.quantile import exact_quantiles, leading_digit
from tallyfin.operators import models, risk


def series(seed, sizes):
    rng = np.random.default_rng(seed)
    return [(k, i, float(rng.normal(0, 0.02))) for k, n in sizes.items() for i in range(n)]


def frame(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"ticker {kind}, ts int, ret double").repartition(5)


def folded(rows, step, first):
    """(key, ts) -> state before the row's step, by a loop."""
    out, by_key = {}, {}
    for k, i, x in rows:
        by_key.setdefault(k, []).append((i, x))
    for k, s in by_key.items():
        values = [x for _, x in sorted(s) if x is not None]
        mean, h = (np.mean(values), np.var(values)) if values else (0.0, None)
        h = first(h)
        for i, x in sorted(s):
            out[k, i] = h
            h = h if x is None else step(h, x - mean)
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_variances_whatever_the_number_of_blocks(spark, n):
    sizes = {"long": 700, None: 60, "one": 1, **{f"k{i}": 2 + i % 5 for i in range(40)}}
    rows = [(k, i, None if (k, i) == ("long", 300) else x) for k, i, x in series(1, sizes)]
    df = frame(spark, rows)
    got = {(r.ticker, r.ts): r.variance for r in models.garch_filter(df, 0.00001, 0.1, 0.85, blocks=n).collect()}
    want = folded(rows, lambda h, e: 0.00001 + 0.1 * e * e + 0.85 * h, lambda h: h)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    gjr = {(r.ticker, r.ts): r.variance for r in models.gjr_filter(df, 0.00001, 0.1, 0.2, 0.7, blocks=n).collect()}
    want = folded(rows, lambda h, e: 0.00001 + (0.1 + 0.2 * (e < 0)) * e * e + 0.7 * h, lambda h: h)
    assert all(gjr[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_a_long_series_spans_many_blocks_and_none_gathers_it(spark):
    rows = frame(spark, series(2, {"only": 40_000}))
    found = models.garch_filter(rows, 1e-5, 0.1, 0.85, blocks=16).withColumn("_p", F.spark_partition_id())
    per_task = [r["count"] for r in found.groupBy("_p").count().collect()]
    assert len(per_task) == 16 and max(per_task) < 3 * 40_000 / 16
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan


def regimes(values, calm, wild, stay):
    density = lambda x, m, d: math.exp(-(((x - m) / d) ** 2) / 2) / (math.sqrt(2 * math.pi) * d)
    p, out = 0.5, []
    for x in values:
        prior = p * stay[1] + (1 - p) * (1 - stay[0])
        a, b = (1.0, 1.0) if x is None else (density(x, *calm), density(x, *wild))
        p = prior * b / (prior * b + (1 - prior) * a) if a + b > 0 else prior
        out.append(p)
    return out


@pytest.mark.parametrize("n", [1, 9])
def test_regimes_in_blocks(spark, n):
    rng = np.random.default_rng(4)
    values = [None if i == 50 else float(rng.normal(0, 0.5 if i % 100 < 60 else 5.0)) for i in range(500)] + [1e6, 0.1]
    df = frame(spark, [("a", i, x) for i, x in enumerate(values)] + [("b", i, x) for i, x in enumerate(values[:9])])
    got = {(r.ticker, r.ts): r.wild for r in models.regime_filter(df, (0.0, 0.5), (0.0, 5.0), (0.95, 0.9), blocks=n).collect()}
    want = regimes(values, (0.0, 0.5), (0.0, 5.0), (0.95, 0.9))
    assert all(got["a", i] == pytest.approx(p, abs=1e-9) for i, p in enumerate(want)) and got["b", 8] == pytest.approx(want[8], abs=1e-9)
    with pytest.raises(ValueError):
        models.regime_filter(df, (0.0, 0.5), (0.0, 5.0), (1.0, 0.9))


def test_maps_compose_as_they_are_applied():
    rng = np.random.default_rng(6)
    for kind, state in ((blocks.Affine, np.array([0.3])), (blocks.Weights, np.array([0.4, 0.6]))):
        maps = rng.uniform(0.1, 1.0, size=(137, kind.width))
        s, all_states = state, []
        for m in maps:
            s = kind.apply(m, s)
            all_states.append(s)
        assert np.allclose(blocks.states(kind, maps, state), all_states) and np.allclose(kind.apply(blocks.product(kind, maps), state), s)
        assert np.allclose(kind.apply(kind.reset(state), rng.uniform(0.1, 1, kind.states)), state)
    tiny = rng.uniform(0.1, 1, (300, 4)) * 10.0 ** rng.integers(-200, 0, (300, 1))  # two of them make none in floating point
    assert np.isfinite(blocks.states(blocks.Weights, tiny, state)).all() and blocks.product(blocks.Weights, tiny).max() == 1
    assert blocks.states(blocks.Affine, np.zeros((0, 2)), np.zeros(1)).shape == (0, 1)


def test_empty_series(spark):
    df = frame(spark, []).filter("ts > 5")
    assert models.garch_filter(df, 0.1, 0.1, 0.8).count() == 0 and models.regime_filter(df, (0.0, 1.0), (0.0, 5.0), (0.9, 0.9)).count() == 0


LEVELS = (0.0, 0.01, 0.05, 0.5, 0.777, 0.99, 1.0)


def check_quantiles(spark, groups, gathered):
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r for r in exact_quantiles(df, "v", LEVELS, ["k"], gathered).collect()}
    want = {r.k: r for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, LEVELS))).alias("q"), F.count("v").alias("n")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].n == want[k].n and all(a == pytest.approx(b, rel=1e-12, nan_ok=True) for a, b in zip(got[k].q, want[k].q)), k


@pytest.mark.parametrize("gathered", [1, 20, 4096])
def test_quantiles_are_exact(spark, gathered):
    rng = np.random.default_rng(8)
    check_quantiles(spark, {
        "normal": rng.normal(size=3000).tolist(), "ties": rng.integers(0, 3, 500).astype(float).tolist(), "one": [4.5], "two": [1.0, 2.0], "same": [7.25] * 300, "none": [None],
        "scales": (rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)).tolist(), "signs": [-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308, None, None], "odd": [float("inf"), float("-inf"), 1.0, 2.0, float("nan")],
        "close": (1.0 + rng.integers(0, 2000, 2000) * 2.0**-52).tolist(), None: [3.0, 1.0, 2.0],
    }, gathered)


def test_digits_never_decrease(spark):
    values = sorted([0.0, 5e-324, 1e-310, 1e-300, 1.0, 2.0**0.0625, 1.9999999999999998, 2.0, 1e308, float("inf")] + [2.0 ** (k / 16) for k in range(-160, 160)])
    values = [-v for v in reversed(values)] + values
    digits = [r.d for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(leading_digit(F.col("v")).alias("d")).collect()]
    assert digits == sorted(digits) and len(set(digits)) > 500


def test_value_at_risk_gathers_no_key(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("hot", float(x)) for x in rng.normal(size=20_000)] + [("few", float(x)) for x in rng.normal(size=7)], "ticker string, ret double")
    got = {r.ticker: r for r in risk.historical(df).collect()}
    for k, x in df.toPandas().groupby("ticker")["ret"]:
        q = np.quantile(x, 0.05)
        assert got[k]["var"] == pytest.approx(-q) and got[k]["cvar"] == pytest.approx(-x[x <= q].mean())
    plan = exact_quantiles(df, "ret", (0.05,), ["ticker"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "partial_collect_list" in plan
    assert risk.historical(df.limit(0)).count() == 0
