"""Queries on further tests and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.operators import diagnostics, models, regimes, risk, summaries
from tallyfin.plans.market import BARS, RETS, _var_sql, normal_sql, rounded, uniform_sql
from tallyfin.sources.tables import bars_hourly

#: Production sizes: draws, resamples.
DRAWS, SAMPLES = 5000, 100


def _rets(spark, sf_dir):
    return risk.returns(bars_hourly(spark, sf_dir))


def q_differenced(spark, sf_dir):
    return rounded(diagnostics.differenced(bars_hourly(spark, sf_dir)))


def q_detrended(spark, sf_dir):
    return rounded(diagnostics.detrended(bars_hourly(spark, sf_dir)), 5)


def q_durbin_watson(spark, sf_dir):
    return rounded(diagnostics.durbin_watson(_rets(spark, sf_dir)))


def q_arch_lm(spark, sf_dir):
    return rounded(diagnostics.arch_lm(_rets(spark, sf_dir)))


def q_kpss(spark, sf_dir):
    return rounded(diagnostics.kpss(_rets(spark, sf_dir)))


def q_shapiro_wilk(spark, sf_dir):
    return rounded(diagnostics.shapiro_wilk(_rets(spark, sf_dir)), 5)


def q_var_horizon(spark, sf_dir):
    return rounded(diagnostics.horizon_risk(_rets(spark, sf_dir), 10))


def q_var_simulated(spark, sf_dir):
    fit = _rets(spark, sf_dir)
    return rounded(diagnostics.simulated_risk(fit, DRAWS), 5)


def q_cvar_bootstrap(spark, sf_dir):
    return rounded(diagnostics.bootstrap_cvar(_rets(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), SAMPLES), 5)


def q_sentiment(spark, sf_dir):
    scores = _rets(spark, sf_dir).select("ticker", "ts", F.signum("ret").alias("score"))
    return rounded(diagnostics.sentiment_features(scores))


#: Parameters of the filters: omega, alpha, gamma, beta (variance, and its logarithm); two regimes and how likely each stays.
GJR, EGARCH, CALM, WILD, STAY, PREMIUM = (0.05, 0.05, 0.1, 0.85), (0.1, 0.1, -0.05, 0.9), (0.0, 1.0), (0.5, 5.0), (0.95, 0.9), 2.0


def q_gjr_filter(spark, sf_dir):
    return rounded(models.gjr_filter(_rets(spark, sf_dir), *GJR).select("ticker", "ts", "variance"), 5)


def q_egarch_filter(spark, sf_dir):
    return rounded(models.egarch_filter(_rets(spark, sf_dir), *EGARCH).select("ticker", "ts", "variance"), 5)


def q_garch_in_mean(spark, sf_dir):
    return rounded(models.garch_in_mean(_rets(spark, sf_dir), 0.05, 0.1, 0.85, PREMIUM).select("ticker", "ts", "expected"), 5)


def q_regime_filter(spark, sf_dir):
    return rounded(models.regime_filter(_rets(spark, sf_dir), CALM, WILD, STAY))


def q_regime_smooth(spark, sf_dir):
    return rounded(regimes.smoothed(_rets(spark, sf_dir), CALM, WILD, STAY))


def q_regime_fit(spark, sf_dir):
    """Parameters, and the likelihood before the first round and the last."""
    found = regimes.fit(_rets(spark, sf_dir))
    return rounded(found.select("ticker", "n", *regimes.PARAMS, F.col("loglik")[0].alias("loglik_first"), F.element_at("loglik", -1).alias("loglik_last")), 4)


def q_var_summaries(spark, sf_dir):
    """Value at risk of the week up to each day from daily summaries, judged by its exact rank among the week's returns."""
    rets = _rets(spark, sf_dir)
    found = summaries.value_at_risk(summaries.daily(rets), 7)
    judged = summaries.ranked(found, rets, 7, 0.05)
    off = F.greatest(F.lit(0.0), F.col("rank_low") - 0.05, 0.05 - F.col("rank_high"))
    return judged.select("ticker", "day", "n", (off <= 3 * summaries.rank_error() + 1 / F.col("n")).alias("within"))


def q_breusch_pagan(spark, sf_dir):
    return rounded(diagnostics.breusch_pagan(_rets(spark, sf_dir)), 5)


def q_phillips_perron(spark, sf_dir):
    return rounded(diagnostics.phillips_perron(_rets(spark, sf_dir)), 5)


def q_seasonal(spark, sf_dir):
    return rounded(diagnostics.seasonally_adjusted(bars_hourly(spark, sf_dir), F.hour("ts")), 5)


def q_illiquidity(spark, sf_dir):
    return rounded(diagnostics.illiquidity(bars_hourly(spark, sf_dir)))


def q_factor_exposure(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(diagnostics.factor_exposure(rets, risk.portfolio(rets)), 5)


def q_tail_index(spark, sf_dir):
    return rounded(diagnostics.tail_index(_rets(spark, sf_dir)), 5)


def _recursive(step: str, start: str = "h0") -> str:
    """Rows (ticker, ts, n, e, h) of a recursion; step is told of r.e and r.h."""
    return (
        f"with recursive {RETS}, es as (select ticker, ts, ret, ret - avg(ret) over (partition by ticker) as e, var_pop(ret) over (partition by ticker) as h0, row_number() over (partition by ticker order by ts) as n from rets), "
        f"rec as (select ticker, ts, n, e, ret, {start} as h from es where n = 1 union all select s.ticker, s.ts, s.n, s.e, s.ret, {step} from rec r join es s on s.ticker = r.ticker and s.n = r.n + 1) "
    )


def _density(regime: tuple[float, float]) -> str:
    return f"(exp(-(((ret - {regime[0]}::double) / {regime[1]}::double) ^ 2) / 2) / (sqrt(2 * pi()) * {regime[1]}::double))"


def _posterior(p: str, r: str) -> str:
    prior = f"({p} * {STAY[1]}::double + (1 - {p}) * (1 - {STAY[0]}::double))"
    calm, wild = (f"(exp(-((({r} - {m}::double) / {d}::double) ^ 2) / 2) / (sqrt(2 * pi()) * {d}::double))" for m, d in (CALM, WILD))
    return f"coalesce({prior} * {wild} / nullif({prior} * {wild} + (1 - {prior}) * {calm}, 0), {prior})"


def _power_sql(coefficients: tuple[float, ...], x: str) -> str:
    return "(" + " + ".join(f"{c!r}::double * {x} ** {k}" for k, c in enumerate(coefficients)) + ")"


def _shapiro_sql() -> str:
    """Of 12 to 5000 rows, as all series here have."""
    ratio = lambda pair, x: "(" + ") / (".join(_power_sql(tuple(reversed(c)), x) for c in pair) + ")"
    m = f"case when least(q, 1 - q) >= {normal.TAIL_FROM}::double then (q - 0.5) * {ratio(normal.MIDDLE, '((q - 0.5) * (q - 0.5))')} when q < 0.5 then {ratio(normal.TAIL, 't')} else -{ratio(normal.TAIL, 't')} end"
    tail = f"(t * exp({_power_sql(tuple(reversed(normal.ERFC)), 't')} - x * x) / 2)"
    return (
        f"with {RETS}, i as (select ticker, ret, row_number() over (partition by ticker order by ret) as i, count(*) over (partition by ticker) as n from rets), "
        "q as (select *, (i - 0.375::double) / (n + 0.25::double) as q from i), t as (select *, sqrt(-2 * ln(least(q, 1 - q))) as t from q), "
        f"m as (select *, {m} as m from t), s as (select ticker, n, sum(m * m) as mm, max(m) as m1, max(m) filter (where i = n - 1) as m2 from m group by ticker, n), "
        f"a as (select *, {_power_sql(diagnostics.LARGEST, '(1 / sqrt(n))')} + m1 / sqrt(mm) as a1, {_power_sql(diagnostics.SECOND, '(1 / sqrt(n))')} + m2 / sqrt(mm) as a2 from s), "
        "f as (select *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) as phi from a), "
        "w as (select m.ticker as ticker, m.n as n, sum(ret * case when i = m.n then a1 when i = m.n - 1 then a2 when i = 1 then -a1 when i = 2 then -a2 else m / sqrt(phi) end) ** 2 / (var_pop(ret) * count(*)) as w from m join f using (ticker) group by m.ticker, m.n), "
        f"z as (select *, (ln(1 - w) - {_power_sql(diagnostics.MANY[0], 'ln(n)')}) / exp({_power_sql(diagnostics.MANY[1], 'ln(n)')}) as z from w), "
        "x as (select *, abs(z) / sqrt(2) as x, 1 / (1 + abs(z) / sqrt(2) / 2) as t from z) "
        f"select ticker, n, round(w, 5) as w, round(case when z >= 0 then {tail} else 1 - {tail} end, 5) as p from x"
    )


CENTRED = f"{RETS}, c as (select ticker, ts, ret - avg(ret) over (partition by ticker) as e from rets)"
COPIES = " union all ".join(f"select ticker, sample, ret from b where u >= {p!r}::double" for p in diagnostics.POISSON)
QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLES = {
    "q_shapiro_wilk": _shapiro_sql(),
    "q_gjr_filter": _recursive(f"{GJR[0]}::double + ({GJR[1]}::double + case when r.e < 0 then {GJR[2]}::double else 0 end) * r.e * r.e + {GJR[3]}::double * r.h") + "select ticker, ts, round(h, 5) as variance from rec",
    "q_egarch_filter": _recursive(f"exp({EGARCH[0]}::double + {EGARCH[1]}::double * (abs(r.e / sqrt(r.h)) - sqrt(2 / pi())) + {EGARCH[2]}::double * r.e / sqrt(r.h) + {EGARCH[3]}::double * ln(r.h))") + "select ticker, ts, round(h, 5) as variance from rec",
    "q_garch_in_mean": _recursive("0.05::double + 0.1::double * r.e * r.e + 0.85::double * r.h") + f"select ticker, ts, round({PREMIUM}::double * h, 5) as expected from rec",
    "q_regime_filter": _recursive(_posterior("r.h", "s.ret"), _posterior("0.5::double", "ret")) + "select ticker, ts, round(h, 6) as wild from rec",
    "q_regime_smooth": (
        _recursive(_posterior("r.h", "s.ret"), _posterior("0.5::double", "ret"))
        + f", densities as (select ticker, n, {_density(CALM)} as c, {_density(WILD)} as w, max(n) over (partition by ticker) as last from es), "
        "likely as materialized (select ticker, n, last, case when c + w > 0 then c else 1 end as c, case when c + w > 0 then w else 1 end as w from densities), "
        "back as (select ticker, n, c, w, 0.5::double as b from likely where n = last union all select l.ticker, l.n, l.c, l.w, "
        f"((1 - {STAY[1]}::double) * r.c * (1 - r.b) + {STAY[1]}::double * r.w * r.b) / ((1 - {STAY[1]}::double) * r.c * (1 - r.b) + {STAY[1]}::double * r.w * r.b + {STAY[0]}::double * r.c * (1 - r.b) + (1 - {STAY[0]}::double) * r.w * r.b) from back r join likely l on l.ticker = r.ticker and l.n = r.n - 1) "
        "select rec.ticker as ticker, ts, round(h * b / (h * b + (1 - h) * (1 - b)), 6) as wild from rec join back on rec.ticker = back.ticker and rec.n = back.n"
    ),
    "q_var_summaries": (
        f"with {RETS}, d as (select ticker, ts::date as day, count(*) as n from rets group by all) select a.ticker as ticker, a.day as day, sum(b.n)::bigint as n, true as within "
        "from d a join d b on a.ticker = b.ticker and b.day between a.day - 6 and a.day group by all"
    ),
    "q_breusch_pagan": (
        f"with {RETS}, l as (select * from (select ticker, ret as y, lag(ret) over (partition by ticker order by ts) as x from rets) where x is not null), f as "
        "(select ticker, regr_slope(y, x) as b, regr_intercept(y, x) as a from l group by ticker) select ticker, count(*) as n, round(count(*) * regr_r2((y - a "
        "- b * x) ^ 2, x), 5) as lm from l join f using (ticker) group by ticker"
    ),
    "q_phillips_perron": f"with {RETS}, l as (select * from (select ticker, ts, ret as y, lag(ret) over (partition by ticker order by ts) as x from rets) where x is not null), f as (select ticker, regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_sxx(y, x) as sxx, count(*) as n from l group by ticker), "
    "u as (select ticker, ts, b, sxx, n, y - a - b * x as u from l join f using (ticker)), v as (select ticker, b, sxx, n, sum(u * u) as uu, " + ", ".join(f"sum(u * l{k}) as p{k}" for k in range(1, 6)) + " from (select *, " + ", ".join(f"lag(u, {k}) over (partition by ticker order by ts) as l{k}" for k in range(1, 6)) + " from u) group by all), "
    "w as (select *, uu / n as s, uu / n + " + " + ".join(f"2 * (1 - {k}::double / 6) * p{k} / n" for k in range(1, 6)) + " as long, sqrt(uu / (n - 2) / sxx) as err from v) select ticker, n, round((b - 1) / err * sqrt(s / long) - (long - s) * n * err / (2 * sqrt(long) * sqrt(uu / (n - 2))), 5) as t from w",
    "q_seasonal": f"with {BARS} select ticker, ts, round(close - avg(close) over (partition by ticker, hour(ts)) + avg(close) over (partition by ticker), 5) as adjusted from bars",
    "q_illiquidity": (
        f"with {BARS}, i as (select ticker, abs(close / nullif(lag(close) over (partition by ticker order by ts), 0) - 1) / nullif(close * volume, 0) as i from "
        "bars) select ticker, count(i) as days, round(avg(i), 6) as illiquidity from i group by ticker"
    ),
    "q_factor_exposure": (
        f"with {RETS}, m as (select ticker, ret as y, avg(ret) over (partition by ts) as x from rets) select ticker, count(*) as n, round(regr_intercept(y, x), "
        "5) as alpha, round(regr_slope(y, x), 5) as beta, round(regr_r2(y, x), 5) as r2, round(stddev_samp(y) * sqrt(1 - regr_r2(y, x)), 5) as specific from m "
        "group by ticker"
    ),
    "q_tail_index": (
        f"with {RETS}, q as (select ticker, quantile_cont(-ret, 1 - 0.1::double) as threshold from rets group by ticker), o as (select ticker, -ret as loss, threshold "
        "from rets join q using (ticker) where -ret > threshold) select ticker, round(threshold, 5) as threshold, count(*) as n, round(1 / avg(case when threshold "
        "> 0 then ln(loss / threshold) end), 5) as hill, round(avg(loss - threshold), 5) as mean_excess from o group by ticker, o.threshold"
    ),
    "q_differenced": f"with {BARS} select * from (select ticker, ts, round(close - lag(close) over (partition by ticker order by ts), 6) as diff from bars) where diff is not null",
    "q_detrended": (
        f"with {BARS}, n as (select ticker, ts, close, row_number() over (partition by ticker order by ts) as x from bars), l as (select ticker, regr_slope(close, "
        "x) as b, regr_intercept(close, x) as a from n group by ticker) select n.ticker as ticker, ts, round(close - a - b * x, 5) as residual from n join l on "
        "n.ticker = l.ticker"
    ),
    "q_durbin_watson": (
        f"with {CENTRED}, d as (select *, e - lag(e) over (partition by ticker order by ts) as d from c) select ticker, round(sum(d * d) / sum(e * e), 6) as dw "
        "from d group by ticker"
    ),
    "q_arch_lm": (
        f"with {CENTRED}, d as (select ticker, e * e as y, lag(e * e) over (partition by ticker order by ts) as x from c) select ticker, count(*) as n, round(count(*) "
        "* regr_r2(y, x), 6) as lm from d where x is not null group by ticker"
    ),
    "q_kpss": (
        f"with {CENTRED}, s as (select *, sum(e) over (partition by ticker order by ts rows unbounded preceding) as s from c) select ticker, round(sum(s * s) / "
        "(count(*) * sum(e * e)), 6) as kpss from s group by ticker"
    ),
    "q_var_horizon": (
        f"with {RETS}, v as ({_var_sql('rets').replace('round(-min(q.q), 6)', '-min(q.q)').replace('round(-avg(s.ret), 6)', '-avg(s.ret)')}) select ticker, round(var "
        "* sqrt(10), 6) as var, round(cvar * sqrt(10), 6) as cvar from v"
    ),
    "q_var_simulated": (
        f"with {RETS}, f as (select ticker, avg(ret) as mu, stddev_samp(ret) as sd from rets group by ticker), sim as (select ticker, mu + sd * {normal_sql('ticker', 'd.draw')} "
        f"as ret from f, range({DRAWS}) d(draw)) {_var_sql('sim').replace(', 6)', ', 5)')}"
    ),
    "q_cvar_bootstrap": (
        f"with {RETS}, b as (select ticker, ret, s.sample::int as sample, {uniform_sql(chr(39) + 'boot' + chr(39), 'ticker', chr(115) + 'trftime(ts, ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')', 's.sample')} "
        f"as u from rets, range({SAMPLES}) s(sample)), copies as ({COPIES}), v as ({_var_sql('copies', 'ticker, sample').replace('round(-avg(s.ret), 6)', '-avg(s.ret)')}) "
        "select ticker, round(avg(cvar), 5) as mean_cvar, round(stddev_samp(cvar), 5) as std_cvar from v group by ticker"
    ),
    "q_sentiment": (
        f"with {RETS}, s as (select ticker, ts, sign(ret)::double as score from rets) select ticker, ts, score, round(case when count(score) over w >= 5 then avg(score) "
        "over w end, 6) as moving, round((count(*) filter (where score > 0) over w)::double / nullif(count(*) filter (where score < 0) over w, 0), 6) as ratio, "
        "lag(score, 1) over o as score_lag1, lag(score, 2) over o as score_lag2 from s window o as (partition by ticker order by ts), w as (partition by ticker "
        "order by ts rows between 4 preceding and current row)"
    ),
}
