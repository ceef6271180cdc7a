"""Normality and unit-root tests at published points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.operators import diagnostics, models

#: Weights of eleven men (Shapiro and Wilk 1965), and miles a gallon of 32 cars (Henderson and Velleman 1981), with the published W and p.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
MILES = [21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4]


def shapiro(spark, groups):
    rows = [(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "ticker string, ret double").repartition(3)
    return {r.ticker: r for r in diagnostics.shapiro_wilk(df).collect()}


def test_published_points(spark):
    got = shapiro(spark, {"weights": WEIGHTS, "miles": MILES, None: [*MILES, None], "same": [1.0] * 9, "two": [1, 2], "three": [1.0, 2.0, 4.0]})
    assert got["weights"].w == pytest.approx(0.79, abs=0.005) and got["weights"].p == pytest.approx(0.0067, abs=0.0005)
    assert got["miles"].w == pytest.approx(0.94756, abs=2e-5) and got["miles"].p == pytest.approx(0.1229, abs=2e-4)
    assert got[None].w == pytest.approx(got["miles"].w) and got[None].n == 32
    assert got["same"].w is None and got["two"].p is None and (got["two"].n, got["same"].n) == (2, 9)
    # of three rows: half the squared range over the squares about the mean, and its exact distribution
    w = 4.5 / (14 / 3)
    assert got["three"].w == pytest.approx(w) and got["three"].p == pytest.approx(6 / math.pi * (math.asin(w**0.5) - math.asin(0.75**0.5)))


def test_normal_values_pass_and_others_do_not(spark):
    rng = random.Random(6)
    groups = {f"n{n}": [rng.gauss(3, 2) for _ in range(n)] for n in (4, 5, 6, 11, 12, 200, 5000)} | {f"e{n}": [rng.expovariate(1) for _ in range(n)] for n in (40, 5000)}
    got = shapiro(spark, groups | {"long": [rng.gauss(0, 1) for _ in range(5001)]})
    assert all(got[k].p > 0.01 and 0 < got[k].w <= 1 for k in groups if k[0] == "n") and got["e40"].p < 0.01 and got["e5000"].p < 1e-6
    assert got["long"].w is None and got["long"].n == 5001


def test_upper_tail(spark):
    z = [k / 10 for k in range(-60, 61)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", normal.upper_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(r.z / 2**0.5) / 2, rel=2e-7, abs=1e-12) for r in got)


def test_p_value_of_the_unit_root_test():
    for level, p in (("1%", 0.01), ("5%", 0.05), ("10%", 0.10)):
        assert models.p_value(models.critical_value(level, 10**9)) == pytest.approx(p, rel=0.02)
    assert models.p_value(-30.0) == 0 and models.p_value(3.0) == 1 and models.p_value(0.0) == pytest.approx(0.9585, abs=1e-3) and math.isnan(models.p_value(math.nan))
    inside = [models.p_value(-18 + k / 10) for k in range(200)]
    assert all(a <= b + 1e-3 for a, b in zip(inside, inside[1:]))
