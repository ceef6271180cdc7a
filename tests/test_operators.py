import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfin.functions import normal, series
from tallyfin.operators import models, montecarlo, risk, screen, textclean, valuation


def table(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, i, v) for i, v in enumerate(values)], "ticker string, ts int, close double")


def rets(spark, values):
    return table(spark, values).select("ticker", "ts", F.col("close").alias("ret"))


def test_returns(spark):
    w = series.ordered("ticker", "ts")
    got = table(spark, [1.0, 2.0, 4.0, 8.0]).select(series.simple_return(F.col("close"), w), series.log_return(F.col("close"), w)).collect()
    assert [r[0] for r in got] == [None, 1, 1, 1] and got[1][1] == pytest.approx(math.log(2))
    zero = table(spark, [3.0, 0.0, 2.0]).select(series.simple_return(F.col("close"), w)).collect()
    assert [r[0] for r in zero] == [None, -1, None]


def test_rolling_is_gated(spark):
    w = series.ordered("ticker", "ts")
    got = table(spark, [1.0, None, 3.0, 4.0]).select(series.rolling_mean(F.col("close"), w, 2)).collect()
    assert [r[0] for r in got] == [None, None, None, 3.5]


def test_keys_do_not_leak(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 10.0), ("b", 4, 20.0)], "ticker string, ts int, close double")
    got = df.select("ts", series.simple_return(F.col("close"), series.ordered("ticker", "ts")).alias("r")).orderBy("ts").collect()
    assert [r.r for r in got] == [None, 1, None, 1]


def test_business_day(spark):
    days = spark.createDataFrame([(dt.date(2024, 9, 30 - k),) for k in range(4)], "d date")
    got = {r.d.strftime("%a"): r.p.strftime("%a") for r in days.select("d", series.previous_business_day(F.col("d")).alias("p")).collect()}
    assert got == {"Mon": "Fri", "Sun": "Fri", "Sat": "Fri", "Fri": "Thu"}


@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.floats(-0.2, 0.2, allow_nan=False), min_size=5, max_size=40), shift=st.floats(-0.1, 0.1))
def test_risk_properties(spark, values, shift):
    base = risk.historical(rets(spark, values)).first()
    moved = risk.historical(rets(spark, [v + shift for v in values])).first()
    double = risk.historical(rets(spark, [2 * v for v in values])).first()
    assert base["cvar"] >= base["var"] - 1e-12
    assert moved["var"] == pytest.approx(base["var"] - shift, abs=1e-9)
    assert double["var"] == pytest.approx(2 * base["var"], abs=1e-9)


def test_confidence_is_checked(spark):
    with pytest.raises(ValueError):
        risk.historical(rets(spark, [0.1]), 1.0)


def test_mixed_scenario(spark):
    r = rets(spark, [0.01 * math.sin(i) for i in range(60)])
    base = risk.historical(r).first()
    got = {x.scenario: x for x in risk.stress_test(r).collect()}
    assert got["Mixed Scenario"]["var"] == pytest.approx(1.5 * (base["var"] + 0.05), abs=1e-9)
    assert got["Prolonged Decline"]["var"] == pytest.approx(0.02, abs=1e-9)


def test_portfolio_of_one(spark):
    r = rets(spark, [0.1, -0.2, 0.3])
    assert sorted(x.ret for x in risk.portfolio(r).collect()) == [-0.2, 0.1, 0.3]


def test_posterior(spark):
    bars = spark.createDataFrame([("A", i, 11.0 + i, 9.0 + i, 10.0 + i) for i in range(10)], "ticker string, ts int, high double, low double, close double")
    p = models.posterior(bars).first()
    assert p["post_mean"] == pytest.approx(p["prior_mean"]) and p["post_std"] < min(p["prior_std"], p["like_std"])
    assert models.posterior_grid(models.posterior(bars), 11).count() == 11


def test_dcf_without_chance(spark):
    c = spark.createDataFrame([("X", 100.0, 0.06, 0.10, 0.03, 300.0, 50.0, 10.0)], "company string, fcf double, fcf_growth double, wacc double, terminal_growth double, debt double, cash double, shares double")
    got = montecarlo.valued(c).first()
    assert got["enterprise_value"] == pytest.approx(1670.686347, abs=1e-6) and got["price"] == pytest.approx(142.068635, abs=1e-6)


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = df.repartition(7).select(F.sum(normal.normal("id")), F.stddev("id")).first()[0]
    b = df.coalesce(1).select(F.sum(normal.normal("id"))).first()[0]
    assert a == pytest.approx(b) and abs(a) < 120


def test_gbm_shape(spark):
    m = spark.createDataFrame([("A", 100.0, 0.05, 0.2)], "ticker string, s0 double, mu double, sigma double")
    paths = montecarlo.gbm_paths(m, paths=20)
    assert paths.count() == 20 * 13 and paths.filter("price <= 0").count() == 0
    assert montecarlo.final_statistics(paths).count() == 1
    assert montecarlo.histogram(paths.filter("step = 12"), "price", 5).agg(F.sum("n")).first()[0] == 20


def test_ou_reverts(spark):
    m = spark.createDataFrame([("A", 5.0, 1.0, 0.0, 50.0)], "ticker string, x0 double, mu double, sigma double, theta double")
    assert montecarlo.ou_final(m, paths=1).first()["x_final"] == pytest.approx(1.0, abs=1e-6)


def test_screen_rules(spark):
    f = spark.createDataFrame([("A", dt.date(2020, 1 + 3 * (i % 4), 1).replace(year=2020 + i // 4), *([v] * 6)) for i, v in enumerate([1.0, 1.1, 1.3, 1.7, 2.5, 2.0, 2.0])], "ticker string, calendardate date, roic double, fcfps double, ebitdausd double, grossmargin double, shareswadil double, epsusd double")
    got = [r.roic_incr for r in screen.rules(screen.changes(screen.intrinsic_value(f))).orderBy("calendardate").collect()]
    assert got == [False, False, False, True, True, False, False]


def test_final_tickers(spark):
    d = dt.date(2024, 1, 1)
    picks = spark.createDataFrame([("A", d, 1, 1.0), ("B", d, 2, 1.0), ("C", d, 2, 1.0), ("C", d, 3, 1.0), ("E", d, 3, 1.0)], "ticker string, calendardate date, criterion int, intrinsic_value double")
    assert {r.ticker for r in screen.final_tickers(picks).collect()} == {"A", "B"}


PAGES = [("d", i, t) for i, t in enumerate(["ACME 10-K\nTotal\nx1\nACME 10-K", "ACME 10-K\nTotal\nItem 1A. Risk Factors", "ACME 10-K\nx3", "ACME 10-K \nx4", "ACME 10-K\n\n"], 1)]


def test_text_clean(spark):
    pages = spark.createDataFrame(PAGES, "doc string, page int, text string")
    rep = textclean.repeated_lines(pages)
    assert [(r.line, r.pages) for r in rep.collect()] == [("ACME 10-K", 5)]
    md = textclean.assemble(pages, textclean.strip_repeated(pages, rep)).first()["markdown"]
    assert md == "Total\nx1\n\n\n\nTotal\n## Item 1A. Risk Factors\n\n\n\nx3\n\n\n\nx4\n"
    assert textclean.repeated_lines(pages.filter("page < 3")).count() == 0


def test_headings(spark):
    cases = {"Item 1A. Risk Factors": True, "ITEM 7 - MD&A": True, "item 12 foo": True, "ITEM 12": True, "Item 1": False, "ITEM 1": False, "Items 1": False}
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = {r.line: r.m.startswith("## ") for r in df.select("line", textclean.mark_heading(F.col("line")).alias("m")).collect()}
    assert got == cases


def test_split_lines(spark):
    df = spark.createDataFrame([("a\x0bb\x0cc\x1cd\x85e f\r\ng\n",), ("",)], "t string")
    got = [r[0] for r in df.select(textclean.split_lines(F.col("t"))).collect()]
    assert got == [list("abcdefg"), []]


def test_table_markdown(spark):
    df = spark.createDataFrame([([["A", "B"], ["1", None], ["x\ny", "2"]],), ([["A"]],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(textclean.table_markdown(F.col("rows"))).collect()]
    assert got == ["| A | B |\n| --- | --- |\n| 1 |  |\n| x y | 2 |", ""]


def test_quality_report(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 1000), ("d", 2, "x" * 1000), ("d", 3, "y" * 100), ("e", 1, "z" * 150), ("e", 2, "z" * 150), ("e", 3, "(cid:12)zz")], "doc string, page int, text string")
    got = {r.doc: r for r in textclean.quality_report(pages).collect()}
    assert got["d"].low_text_pages == [3] and got["e"].low_text_pages == [] and got["e"].cid_pages == [3]
    assert "pages 3" in got["d"].warnings


def test_ratios(spark):
    df = spark.createDataFrame([(10.0, 0.0)], "a double, b double")
    assert df.select(valuation.ratio("a", "b")).first()[0] is None
    assert df.select(valuation.dividend_value(F.lit(1.0), F.lit(0.03), F.lit(0.08))).first()[0] == pytest.approx(20.6)


def test_diagnostics(spark):
    from tallyfin.operators import diagnostics as d

    wave = rets(spark, [(-1.0) ** i for i in range(200)])
    assert d.durbin_watson(wave).first()["dw"] == pytest.approx(4 * 199 / 200)
    assert d.kpss(wave).first()["kpss"] < 0.01
    line = table(spark, [3.0 + 2.0 * i for i in range(10)])
    assert {round(r["diff"], 9) for r in d.differenced(line).collect()} == {2.0}
    assert max(abs(r.residual) for r in d.detrended(line).collect()) < 1e-9
    noise = rets(spark, [0.01 * math.sin(37 * i * i) for i in range(120)])
    base, boot = risk.historical(noise).first()["cvar"], d.bootstrap_cvar(noise, 20).first()
    assert boot["mean_cvar"] == pytest.approx(base, rel=0.2) and boot["std_cvar"] >= 0
    assert d.simulated_risk(noise, 2000).first()["var"] == pytest.approx(risk.parametric(noise).first()["var"], rel=0.15)
    s = d.sentiment_features(noise.select("ticker", "ts", F.signum("ret").alias("score")), 5)
    assert s.filter("moving is not null").count() == 116
