"""Figures of generated series against formulas worked out here with numpy, and small cases by hand."""

import datetime as dt
from math import exp, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.functions.scan import scan
from tallyfin.operators import corrgrid, diagnostics, models, montecarlo, risk, screen, textclean, volatility
from tallyfin.sources import filings, sinks, tables
from tests.test_garch import plain_objective

DAY = dt.date(2024, 1, 1)


def make_series(seed, n):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    opened = close * np.exp(rng.normal(0, 0.01, n))
    high, low = np.maximum(opened, close) * (1 + rng.uniform(0, 0.02, n)), np.minimum(opened, close) * (1 - rng.uniform(0, 0.02, n))
    return np.column_stack([opened, high, low, close])


SERIES = {"AAA": make_series(1, 90), "BBB": make_series(2, 75)}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(t, DAY + dt.timedelta(k), *map(float, r)) for t, x in SERIES.items() for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double").repartition(3).cache()


def rets_of(t):
    c = SERIES[t][:, 3]
    return c[1:] / c[:-1] - 1


def test_value_at_risk(bars):
    rets = risk.returns(bars, order="date")
    got = {r.ticker: r for r in risk.historical(rets).collect()}
    both = {(r.ticker, r.confidence): r for r in risk.historical_at(rets, (0.9, 0.95)).collect()}
    near = {r.ticker: r for r in risk.historical(rets, approximate=True).collect()}
    normal_fit = {r.ticker: r for r in risk.parametric(rets).collect()}
    for t in SERIES:
        r = rets_of(t)
        q = np.quantile(r, 0.05)
        assert got[t]["var"] == both[t, 0.95]["var"] == pytest.approx(-q) and got[t]["cvar"] == pytest.approx(-r[r <= q].mean())
        assert both[t, 0.9]["cvar"] == pytest.approx(-r[r <= np.quantile(r, 0.1)].mean()) and near[t]["var"] == pytest.approx(-q, abs=0.01)
        z = NormalDist().inv_cdf(0.05)
        assert normal_fit[t]["var"] == pytest.approx(-(r.mean() + z * r.std(ddof=1)))
        assert normal_fit[t]["cvar_textbook"] == pytest.approx(-r.mean() + r.std(ddof=1) * NormalDist().pdf(z) / 0.05)


def test_look_back_cuts_prices_first(spark):
    rows = [("X", dt.date(2023, 1, 1), 100.0), ("X", dt.date(2024, 1, 1), 50.0), ("X", dt.date(2024, 6, 1), 55.0), ("X", dt.date(2024, 12, 31), 56.0), ("Y", dt.date(2020, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    left = risk.look_back(df, 365)
    assert {(r.ticker, r.close) for r in left.collect()} == {("X", 50.0), ("X", 55.0), ("X", 56.0), ("Y", 1.0)}
    assert sorted(round(r.ret, 6) for r in risk.returns(left, order="date").collect()) == [0.018182, 0.1]


def test_volatility(bars):
    gk = {r.ticker: r.gk_10 for r in models.tail(volatility.garman_klass(bars, order="date"), 1, "date").collect()}
    yz = {r.ticker: r.yz_5 for r in models.tail(volatility.yang_zhang(bars, order="date"), 1, "date").collect()}
    par = {r.ticker: r for r in volatility.gbm_parameters(bars, order="date").collect()}
    for t, x in SERIES.items():
        o, h, low, c = x.T
        term = 0.5 * np.log(h / low) ** 2 - (2 * log(2) - 1) * np.log(c / o) ** 2
        want = sqrt(term[-10:].mean())
        assert gk[t] == pytest.approx(want)
        assert par[t].sigma == pytest.approx(want) and par[t].mu == pytest.approx(np.diff(np.log(c)).mean() * 26 + want**2 / 2) and par[t].s0 == c[-1]
        ho, lo, co = np.log(h / o), np.log(low / o), np.log(c / o)
        rs, oo, cc = ho * (ho - co) + lo * (lo - co), o[1:] / o[:-1] - 1, c[1:] / c[:-1] - 1
        k = 0.34 / (1.34 + 6 / 4)
        assert yz[t] == pytest.approx(sqrt((oo[-5:].var(ddof=1) + k * rs[-5:].mean() + (1 - k) * (cc - oo)[-5:].var(ddof=1)) * 52))


def test_correlation_grid(bars):
    got = {(r.ticker, r.window, r.days): r["corr"] for r in corrgrid.correlation_grid(bars, price="close", order="date").collect()}
    c = SERIES["BBB"][:, 3]
    w, d = sorted((w, d) for t, w, d in got if t == "BBB")[3]
    std = np.array([c[i - w + 1 : i + 1].std(ddof=1) for i in range(w - 1, len(c) - d)])
    fwd = np.array([c[i + d] / c[i] - 1 for i in range(w - 1, len(c) - d)])
    assert got["BBB", w, d] == pytest.approx(np.corrcoef(std, fwd)[0, 1])


def test_autoregression_and_tests(bars):
    fit = {r.ticker: r for r in models.ou_fit(bars, order="date").collect()}
    rets = risk.returns(bars, order="date")
    acf = models.autocorrelation(rets, 6, order="date")
    rho = {(r.ticker, r.lag): r.acf for r in acf.collect()}
    pacf = {(r.ticker, r.lag): r.pacf for r in models.partial_autocorrelation(acf).collect()}
    df = {r.ticker: r for r in models.dickey_fuller(rets, order="date").collect()}
    adf = {k: {r.ticker: r for r in models.augmented_dickey_fuller(rets, k, order="date").collect()} for k in (0, 2)}
    auto = {r.ticker: r for r in models.augmented_dickey_fuller(rets, order="date").collect()}
    for t, x in SERIES.items():
        y = np.log(x[:, 3])
        b, a = np.polyfit(y[:-1], y[1:], 1)
        assert fit[t].slope == pytest.approx(b) and fit[t].theta_euler == pytest.approx((1 - b) * 252) and fit[t].sigma == pytest.approx(np.diff(y).std())
        r = rets_of(t)
        e = r - r.mean()
        known = [1.0] + [float(e[k:] @ e[:-k] / (e @ e)) for k in range(1, 7)]
        for k in range(1, 7):
            assert rho[t, k] == pytest.approx(known[k])
            toeplitz = np.array([[known[abs(i - j)] for j in range(k)] for i in range(k)])
            assert pacf[t, k] == pytest.approx(np.linalg.solve(toeplitz, known[1 : k + 1])[-1])
        assert adf[0][t].t == pytest.approx(df[t].t) and adf[0][t].n == df[t].n
        d = np.diff(r)
        m = np.column_stack([r[2:-1], d[1:-1], d[:-2], np.ones(len(d) - 2)])
        beta = np.linalg.lstsq(m, d[2:], rcond=None)[0]
        s2 = ((d[2:] - m @ beta) ** 2).sum() / (len(d) - 2 - 4)
        assert adf[2][t].t == pytest.approx(beta[0] / sqrt(s2 * np.linalg.inv(m.T @ m)[0, 0]))
        assert 0 <= auto[t].lags <= 12 and -3.6 < auto[t].crit_1 < auto[t].crit_5 < auto[t].crit_10 < -2.5


def test_garch(bars):
    rets = risk.returns(bars, order="date")
    held = {(r.ticker, r.date): r.variance for r in models.garch_filter(rets, 0.00001, 0.1, 0.8, order="date").collect()}
    skew = {(r.ticker, r.date): r.variance for r in models.gjr_filter(rets, 0.00001, 0.05, 0.1, 0.8, order="date").collect()}
    wild = {(r.ticker, r.date): r.wild for r in models.regime_filter(rets, (0.0, 0.01), (0.0, 0.05), (0.9, 0.8), order="date").collect()}
    fit = {r.ticker: r for r in models.garch_fit(rets, order="date").collect()}
    for t in SERIES:
        r = rets_of(t)
        e, h, g, p = r - r.mean(), r.var(), r.var(), 0.5
        density = lambda x, s: exp(-((x / s) ** 2) / 2) / (sqrt(2 * pi) * s)
        for k, x in enumerate(e):
            day = DAY + dt.timedelta(k + 1)
            prior = p * 0.8 + (1 - p) * 0.1
            p = prior * density(r[k], 0.05) / (prior * density(r[k], 0.05) + (1 - prior) * density(r[k], 0.01))
            assert held[t, day] == pytest.approx(h) and skew[t, day] == pytest.approx(g) and wild[t, day] == pytest.approx(p)
            h, g = 0.00001 + 0.1 * x * x + 0.8 * h, 0.00001 + (0.15 if x < 0 else 0.05) * x * x + 0.8 * g
        # the fit is at least as likely as any point of a grid, and keeps its bound
        e2, h0 = (100 * e) ** 2, (100 * r).var()
        grid = [plain_objective(np.array([h0 * (1 - a - b), a, b]), e2, h0) for a in (0.01, 0.05, 0.1, 0.2, 0.4) for b in (0.05, 0.3, 0.5, 0.7, 0.9) if a + b < 0.99]
        assert fit[t].objective <= min(grid) + 1e-6 and fit[t].alpha + fit[t].beta < 1 and fit[t].n == len(r)


def test_scan_over_many_runs(spark):
    df = spark.range(3).select("id", F.expr("transform(sequence(1, id * 700), x -> cast(x as double))").alias("v")).selectExpr("id", "if(id = 0, array(), v) v")
    got = {r.id: r.s for r in df.select("id", scan(F.col("v"), F.lit(1.0), lambda s, x: s * 0.5 + x).alias("s")).collect()}
    for i, s in got.items():
        want = [1.0]
        for x in range(1, i * 700 + 1):
            want.append(want[-1] * 0.5 + x)
        assert s == want


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02425, 0.1, 0.5, 0.7, 0.97575, 0.999, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(normal.quantile_column(F.col("p"))).collect()]
    assert got[-2:] == [None, None]
    for p, q in zip(ps, got):
        assert q == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)


def test_quantile_pairs_and_density(spark, bars):
    rets = risk.returns(bars, order="date").withColumnRenamed("date", "ts")
    pairs = sorted((r.ticker, r.i, r.theoretical, r["sample"]) for r in models.quantile_pairs(models.garch_filter(rets, 0.0, 0.1, 0.8)).collect())
    n = len(rets_of("AAA"))
    assert [p[1] for p in pairs if p[0] == "AAA"] == list(range(1, n + 1)) and pairs[0][2] == pytest.approx(NormalDist().inv_cdf(0.5 / n))
    assert [p[3] for p in pairs if p[0] == "AAA"] == sorted(p[3] for p in pairs if p[0] == "AAA")
    r = rets_of("AAA")
    grid = sorted((x.x, x.density) for x in montecarlo.kernel_density(rets, "ret", 7).filter("ticker = 'AAA'").collect())
    h = r.std(ddof=1) * len(r) ** -0.2
    for (x, d), at in zip(grid, np.linspace(r.min(), r.max(), 7)):
        assert x == pytest.approx(at) and d == pytest.approx(np.mean(np.exp(-(((at - r) / h) ** 2) / 2) / (sqrt(2 * pi) * h)))


def test_mean_reversion_and_copies(spark):
    m = spark.createDataFrame([("A", 1.0, 0.5, 0.0, 2.0)], "ticker string, x0 double, mu double, sigma double, theta double")
    path = montecarlo.ou_paths(m, 1.0, 1 / 4, 1).first().x
    assert path == pytest.approx([1.0, 0.75, 0.625, 0.5625, 0.53125])
    assert diagnostics.POISSON[0] == pytest.approx(exp(-1)) and len(diagnostics.POISSON) > 12


def test_further_tests(bars):
    rets = risk.returns(bars, order="date")
    bp = {r.ticker: r for r in diagnostics.breusch_pagan(rets, order="date").collect()}
    pp = {r.ticker: r for r in diagnostics.phillips_perron(rets, 3, order="date").collect()}
    tail = {r.ticker: r for r in diagnostics.tail_index(rets).collect()}
    for t in SERIES:
        r = rets_of(t)
        x, y = r[:-1], r[1:]
        b, a = np.polyfit(x, y, 1)
        u, n = y - a - b * x, len(y)
        assert bp[t].lm == pytest.approx(n * np.corrcoef(u**2, x)[0, 1] ** 2)
        s2, short = u @ u / (n - 2), u @ u / n
        long = short + 2 * sum((1 - k / 4) * (u[k:] @ u[:-k]) / n for k in range(1, 4))
        error = sqrt(s2 / ((x - x.mean()) ** 2).sum())
        assert pp[t].t == pytest.approx((b - 1) / error * sqrt(short / long) - (long - short) * n * error / (2 * sqrt(long) * sqrt(s2)))
        over = np.quantile(-r, 0.9)
        assert tail[t].hill == pytest.approx(1 / np.log(-r[-r > over] / over).mean()) and tail[t].n == (-r > over).sum()


def test_horizon_averages(spark, bars):
    starts = spark.createDataFrame([("AAA", DAY), ("AAA", DAY), ("BBB", DAY + dt.timedelta(20)), ("ZZZ", DAY)], "ticker string, start date")
    got = {r.ticker: r for r in screen.horizon_averages(bars, starts).collect()}
    assert set(got) == {"AAA", "BBB", "ZZZ"} and got["ZZZ"].fwd_1 is None
    for t, first, ends in (("AAA", DAY, {1: dt.date(2024, 2, 1), 3: dt.date(2024, 4, 1)}), ("BBB", None, {1: dt.date(2024, 2, 21)})):
        for n, end in ends.items():
            days = [SERIES[t][k, 3] for k in range(len(SERIES[t])) if end - dt.timedelta(30) <= DAY + dt.timedelta(k) <= end]
            assert got[t][f"fwd_{n}"] == pytest.approx(np.mean(days))


def test_point_in_time_and_result(spark, bars):
    means = screen.rolling_averages(bars)
    assert {(r.ticker, r.date) for r in screen.point_in_time(means, F.lit(DAY + dt.timedelta(80))).collect()} == {("AAA", DAY + dt.timedelta(80))}
    last = screen.point_in_time(means, F.lit(DAY + dt.timedelta(80)), exact=False)
    assert {(r.ticker, r.date) for r in last.collect()} == {("AAA", DAY + dt.timedelta(80)), ("BBB", DAY + dt.timedelta(74))}
    final = spark.createDataFrame([(DAY, "BBB")], "calendardate date, ticker string")
    picks = spark.createDataFrame([("AAA", DAY, 1, 5.0), ("BBB", DAY, 2, 6.0), ("BBB", DAY, 2, 6.0)], "ticker string, calendardate date, criterion int, intrinsic_value double")
    meta = spark.createDataFrame([("AAA", "x"), ("BBB", "y")], "ticker string, sector string")
    rows = screen.screen_result(final, last, meta, picks, screen.horizon_averages(bars, final.select("ticker", F.col("calendardate").alias("start")))).collect()
    assert [(r.ticker, r.sector, r.criterion) for r in rows] == [("BBB", "y", 2)]


def test_report_is_written_in_order(spark, bars, tmp_path):
    rets = risk.returns(bars, order="date")
    both = rets.unionByName(risk.portfolio(rets, "date"))
    lines = risk.report_lines(risk.historical(both), risk.stress_test(both, order="date"))
    sinks.write_report(lines, str(tmp_path / "report"))
    said = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(said) == 15 and said[0].startswith("PORTFOLIO: VaR (95%): ") and said[1].startswith("  High Volatility: ") and said[5].startswith("AAA: ") and said[10].startswith("BBB: ")
    picks = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, criterion int")
    sinks.write_by_criterion(picks, str(tmp_path / "picks"))
    assert spark.read.parquet(str(tmp_path / "picks" / "criterion=2")).collect()[0].ticker == "B"
    sinks.write_documents(spark.createDataFrame([("d", "m")], "doc string, markdown string"), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 1


def test_reassembly(spark):
    pages = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("e", 1, " \u00a0\n"), ("f", 1, "\titem 7 - x\n y "), ("f", 2, "")], "doc string, page int, text string")
    rows = [("f", 1, 0, [["h", " k\n"], ["1", None]]), ("f", 1, 1, [["alone"]]), ("f", 2, 0, [["p"], ["q\nr"]])]
    shown = spark.createDataFrame(rows, "doc string, page int, pos int, rows array<array<string>>")
    got = {r.doc: r.markdown for r in textclean.assemble(pages, textclean.page_lines(pages), shown).collect()}
    table = "| h | k |\n| --- | --- |\n| 1 |  |"
    assert got == {"d": "a\n\n\n\nb\n", "e": "\n", "f": f"## item 7 - x\n y\n\n\n\n{table}\n\n\n\n\n\n| p |\n| --- |\n| q r |\n"}


def test_white_space_of_any_kind(spark):
    df = spark.createDataFrame([("\tItem 1A. Risk Factors",), ("Item\u00a07 \u2013 x",), ("Items 1. x",), ("Item 5",), ("\u3000ITEM 51",)], "line string")
    assert [r[0] for r in df.select(textclean.mark_heading(F.col("line"))).collect()] == ["## Item 1A. Risk Factors", "## Item\u00a07 \u2013 x", "Items 1. x", "Item 5", "## ITEM 51"]
    pages = spark.createDataFrame([("d", k, f"ACME{white}\nown {k}") for k, white in enumerate(["", "\t", "\u00a0", " \u2003"])], "doc string, page int, text string")
    assert [(r.line, r.pages) for r in textclean.repeated_lines(pages).collect()] == [("ACME", 4)]
    assert sorted(r.line for r in textclean.strip_repeated(pages, textclean.repeated_lines(pages)).collect()) == [f"own {k}" for k in range(4)]


def test_filings(spark, tmp_path):
    (tmp_path / "one.txt").write_text("head\nItem 1. x\fhead\nmid\fhead\nend", encoding="utf-8")
    (tmp_path / "two.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "three.txt").write_text(" \n", encoding="utf-8")
    markdown, report = filings.convert(filings.read_filings(spark, str(tmp_path), suffix=".txt").cache())
    assert {r.doc: r.markdown for r in markdown.collect()} == {"one": "## Item 1. x\n\n\n\nmid\n\n\n\nend\n", "three": "\n"}
    told = {r.doc: r for r in report.collect()}
    assert told["one"].status == told["three"].status == "converted" and told["one"].pages == 3 and told["three"].warnings == "no text; no tables"
    assert told["two"].status == "failed" and told["two"].warnings.startswith("UnicodeDecodeError")


def test_scan_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1, "a", dt.date(2020, 1, 1), 1.0), (2, "b", dt.date(2021, 1, 1), 2.0)], "k int, s string, day date, v double").write.parquet(str(tmp_path / "t.parquet"))
    df = tables.scan(spark, str(tmp_path), "t", ["k"], {"s": ["a", "b"], "v": 1.0}, ("day", "2020-06-30"))
    assert [r.k for r in df.collect()] == [1]
    plan = df._jdf.queryExecution().toString()
    assert "LessThanOrEqual(day" in plan and "ReadSchema: struct<k:int,s:string,day:date,v:double>" in plan
