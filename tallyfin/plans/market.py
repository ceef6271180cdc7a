"""Queries on prices: returns, risk, volatility, correlation, simulation and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfin.functions import normal, series
from tallyfin.operators import corrgrid, models, montecarlo, risk, volatility
from tallyfin.sources.tables import bars_hourly, bars_weekly

#: SQL of the hourly and weekly bars, and of hourly returns.
BARS = (
    "bars as (select event_type as ticker, date_trunc('hour', ts) as ts, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, "
    "event_id) as close, count(*) as volume from events group by 1, 2)"
)
WEEKS = (
    "weeks as (select o_orderpriority as ticker, date_trunc('week', o_orderdate)::date as date, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as open, max(o_totalprice) as high, "
    "min(o_totalprice) as low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as close, count(*) as volume from orders group by 1, 2)"
)
RETS = f"{BARS}, rets as (select * from (select ticker, ts, close / nullif(lag(close) over w, 0) - 1 as ret from bars window w as (partition by ticker order by ts)) where ret is not null)"
LOG_RETS = f"{BARS}, lrets as (select ticker, ts, ln(close / nullif(lag(close) over w, 0)) as lr, close, open, high, low from bars window w as (partition by ticker order by ts))"
#: Fixed values of the filter and forecast queries.
OMEGA, ALPHA, BETA = 0.05, 0.1, 0.85
#: Production sizes of the simulations: paths, and steps of a year of days.
GBM_PATHS, OU_PATHS, OU_STEPS = 1000, 1000, 252


def _rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.returns(bars_hourly(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some decimals, so that the order of parallel sums does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def q_bars_ohlc(spark, sf_dir):
    return bars_hourly(spark, sf_dir)


def q_bars_weekly(spark, sf_dir):
    return bars_weekly(spark, sf_dir)


def q_simple_return(spark, sf_dir):
    return rounded(_rets(spark, sf_dir), 8)


def q_log_return(spark, sf_dir):
    b = bars_hourly(spark, sf_dir)
    return rounded(b.select("ticker", "ts", series.log_return(F.col("close"), series.ordered("ticker", "ts")).alias("log_ret")).filter("log_ret is not null"), 8)


def q_forward_return(spark, sf_dir):
    w = series.ordered("ticker", "ts")
    return rounded(bars_hourly(spark, sf_dir).select("ticker", "ts", *(series.forward_return(F.col("close"), w, d).alias(f"fwd_{d}") for d in (1, 5, 14))), 8)


def q_annualized_return(spark, sf_dir):
    return rounded(risk.returns(bars_hourly(spark, sf_dir), periods_per_year=252), 7)


def q_var_hist(spark, sf_dir):
    return rounded(risk.historical(_rets(spark, sf_dir)))


def q_var_param(spark, sf_dir):
    return rounded(risk.parametric(risk.returns(bars_hourly(spark, sf_dir), periods_per_year=252)))


def q_var_lookback(spark, sf_dir):
    return rounded(risk.historical(risk.returns(risk.look_back(bars_weekly(spark, sf_dir), 365), order="date")))


def q_var_multi_confidence(spark, sf_dir):
    return rounded(risk.historical_at(_rets(spark, sf_dir), (0.9, 0.95, 0.99)))


def q_stress_scenarios(spark, sf_dir):
    return rounded(risk.stress_test(_rets(spark, sf_dir)))


def q_stress_tail_only(spark, sf_dir):
    only = tuple(s for s in risk.DEFAULT_SCENARIOS if s.tail_days)
    return rounded(risk.stressed(_rets(spark, sf_dir), only).groupBy("ticker", "scenario").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.min("ret").alias("min_ret")))


def q_scenario_table(spark, sf_dir):
    """Each scenario's parameters with the returns that it shifts and those that it replaces, by ticker."""
    counts = _rets(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("rows"))
    scenarios = F.explode(F.array(*(risk.literal(s) for s in risk.DEFAULT_SCENARIOS)))
    made = counts.select("ticker", "rows", scenarios.alias("s")).select("ticker", "rows", "s.*")
    replaced = F.least(F.col("rows"), F.coalesce(F.col("tail_days"), F.lit(0))).cast("long")
    return made.withColumn("replaced", replaced).withColumn("shifted", F.when(F.col("shock").isNotNull() | F.col("vol_mult").isNotNull(), F.col("rows")).otherwise(0))


def q_portfolio_return(spark, sf_dir):
    return rounded(risk.portfolio(_rets(spark, sf_dir)), 8)


def q_portfolio_var(spark, sf_dir):
    return rounded(risk.historical(risk.portfolio(_rets(spark, sf_dir))))


def q_portfolio_stress(spark, sf_dir):
    return rounded(risk.stress_test(risk.portfolio(_rets(spark, sf_dir))))


def _report(spark, sf_dir):
    rets = risk.returns(risk.look_back(bars_hourly(spark, sf_dir), 365, order="ts"))
    both = rets.unionByName(risk.portfolio(rets))
    return risk.report_lines(risk.historical(both), risk.stress_test(both))


def q_risk_report(spark, sf_dir):
    return _report(spark, sf_dir)


def q_risk_report_document(spark, sf_dir):
    return risk.report_document(_report(spark, sf_dir))


def q_rolling_var(spark, sf_dir):
    return rounded(risk.rolling_value_at_risk(_rets(spark, sf_dir), 60))


def q_back_test(spark, sf_dir):
    return rounded(risk.back_test(_rets(spark, sf_dir), 60))


def q_roll_std(spark, sf_dir):
    w = series.ordered("ticker", "ts")
    return rounded(bars_hourly(spark, sf_dir).select("ticker", "ts", *(series.rolling_std(F.col("close"), w, n).alias(f"std_{n}") for n in (3, 7, 14))))


def q_roll_mean_15_30_45(spark, sf_dir):
    w = series.ordered("ticker", "ts")
    return rounded(bars_hourly(spark, sf_dir).select("ticker", "ts", *(series.rolling_mean(F.col("close"), w, n).alias(f"avg_{n}") for n in (15, 30, 45))))


def q_gk_vol(spark, sf_dir):
    return rounded(volatility.garman_klass(bars_hourly(spark, sf_dir)))


def q_yz_vol(spark, sf_dir):
    return rounded(volatility.yang_zhang(bars_hourly(spark, sf_dir)))


def q_gbm_params(spark, sf_dir):
    return rounded(volatility.gbm_parameters(bars_hourly(spark, sf_dir)))


def q_corr_grid(spark, sf_dir):
    return rounded(corrgrid.correlation_grid(bars_hourly(spark, sf_dir)))


def q_corr_best(spark, sf_dir):
    return rounded(corrgrid.best_cell(corrgrid.correlation_grid(bars_hourly(spark, sf_dir))))


def q_corr_matrix(spark, sf_dir):
    wide = corrgrid.matrix(corrgrid.correlation_grid(bars_hourly(spark, sf_dir)))
    return rounded(wide.select("ticker", "window", *(F.col(f"`{d}`").alias(f"days_{d}") for d in corrgrid.HORIZONS)))


def q_corr_row_mean(spark, sf_dir):
    return rounded(corrgrid.window_means(corrgrid.correlation_grid(bars_hourly(spark, sf_dir))))


def _gbm(spark, sf_dir):
    return montecarlo.gbm_paths(_model(volatility.gbm_parameters(bars_hourly(spark, sf_dir))), paths=GBM_PATHS)


def _model(fitted: DataFrame) -> DataFrame:
    """Parameters to six decimals, so that engines that sum in another order simulate the same model."""
    return fitted.select("ticker", *(F.round(c, 6).alias(c) for c in ("s0", "mu", "sigma")))


def q_gbm_yz_paths(spark, sf_dir):
    """Half a year in 26 weekly steps and in 13 of two weeks, by range volatility over 5 and 10 bars; logarithms of prices."""
    bars, out = bars_weekly(spark, sf_dir), None
    vol = volatility.yang_zhang(bars, order="date")
    for steps, column in ((52, "yz_5"), (26, "yz_10")):
        p = _model(volatility.gbm_parameters_by(bars, vol, column, 1 / steps, order="date"))
        part = montecarlo.gbm_paths(p, dt=1 / steps, paths=GBM_PATHS, logs=True).select(F.lit(steps).alias("steps_a_year"), "ticker", "path", "step", "log_price")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 5)


def q_gbm_paths(spark, sf_dir):
    return rounded(_gbm(spark, sf_dir), 4)


def q_gbm_mean_path(spark, sf_dir):
    return rounded(montecarlo.mean_path(_gbm(spark, sf_dir)), 4)


def q_gbm_final_stats(spark, sf_dir):
    return rounded(montecarlo.final_statistics(_gbm(spark, sf_dir)), 4)


def q_mc_histogram(spark, sf_dir):
    last = _gbm(spark, sf_dir).filter("step = 12").select("ticker", F.round("price", 4).alias("price"))
    return rounded(montecarlo.histogram(last, "price"), 4)


def q_kernel_density(spark, sf_dir):
    return rounded(montecarlo.kernel_density(_rets(spark, sf_dir), "ret", 20))


def _ou_models(spark, sf_dir):
    fit = models.ou_fit(bars_hourly(spark, sf_dir))
    return fit.select("ticker", *(F.round(c, 7).alias(c) for c in ("x0", "mu", "sigma")), F.round("theta_euler", 7).alias("theta"))


def q_ou_final_stats(spark, sf_dir):
    final = montecarlo.ou_final(_ou_models(spark, sf_dir), OU_STEPS / 252, paths=OU_PATHS)
    return rounded(montecarlo.summary(final.withColumn("price", F.exp("x_final")), "price"), 4)


def q_ou_paths(spark, sf_dir):
    """Every path of every step, told by its ends and extremes."""
    p = montecarlo.ou_paths(_ou_models(spark, sf_dir), OU_STEPS / 252, paths=OU_PATHS)
    return rounded(p.select("ticker", "path", F.size("x").cast("long").alias("points"), F.array_min("x").alias("low"), F.array_max("x").alias("high"), "x_final"), 4)


def q_ou_mean_path(spark, sf_dir):
    p = montecarlo.ou_paths(_ou_models(spark, sf_dir), OU_STEPS / 252, paths=OU_PATHS)
    return rounded(p.select("ticker", F.posexplode_outer("x").alias("step", "x")).groupBy("ticker", "step").agg(F.avg(F.exp("x")).alias("mean_price")), 4)


def q_bayes_posterior(spark, sf_dir):
    return rounded(models.posterior(bars_hourly(spark, sf_dir)))


def q_bayes_grid(spark, sf_dir):
    return rounded(models.posterior_grid(models.posterior(bars_hourly(spark, sf_dir))), 7)


def q_ar1_ou_fit(spark, sf_dir):
    return rounded(models.ou_fit(bars_hourly(spark, sf_dir)))


def q_acf(spark, sf_dir):
    return rounded(models.autocorrelation(_rets(spark, sf_dir)))


def q_pacf(spark, sf_dir):
    return rounded(models.partial_autocorrelation(models.autocorrelation(_rets(spark, sf_dir))))


def q_df_test(spark, sf_dir):
    return rounded(models.dickey_fuller(_rets(spark, sf_dir)))


def q_adf(spark, sf_dir):
    return rounded(models.augmented_dickey_fuller(_rets(spark, sf_dir)))


def _filtered(spark, sf_dir):
    return models.garch_filter(_rets(spark, sf_dir), OMEGA, ALPHA, BETA)


def q_garch_filter(spark, sf_dir):
    return rounded(_filtered(spark, sf_dir).select("ticker", "ts", "variance"))


def q_std_resid(spark, sf_dir):
    return rounded(_filtered(spark, sf_dir).select("ticker", "ts", "std_resid"))


def q_garch_forecast(spark, sf_dir):
    return rounded(models.garch_forecast(_filtered(spark, sf_dir), OMEGA, ALPHA, BETA))


def q_mse_rmse(spark, sf_dir):
    rets = _rets(spark, sf_dir)
    return rounded(models.garch_accuracy(rets, models.garch_forecast(models.garch_filter(rets, OMEGA, ALPHA, BETA), OMEGA, ALPHA, BETA)), 5)


def q_garch_fit(spark, sf_dir):
    return rounded(models.garch_fit(risk.returns(bars_weekly(spark, sf_dir), order="date"), order="date"), 3)


def q_qq_pairs(spark, sf_dir):
    return rounded(models.quantile_pairs(_filtered(spark, sf_dir)), 4)


def q_ewma(spark, sf_dir):
    return rounded(models.ewma(_rets(spark, sf_dir)))


def _frames(expr: str, ns: tuple[int, ...], name: str, what: str, source: str = "bars") -> str:
    cols = ", ".join(f"round(case when count({what}) over w{n} >= {n} then {expr.format(x=what)} over w{n} end, 6) as {name}_{n}" for n in ns)
    wins = ", ".join(f"w{n} as (partition by ticker order by ts rows between {n - 1} preceding and current row)" for n in ns)
    return f"select ticker, ts, {cols} from {source} window {wins}"


def _var_sql(source: str, keys: str = "ticker", level: str = "1 - 0.95::double") -> str:
    on = " and ".join(f"s.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    outer = ", ".join(f"s.{k.strip()} as {k.strip()}" for k in keys.split(","))
    group = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"select {outer}, round(-min(q.q), 6) as var, round(-avg(s.ret), 6) as cvar from {source} s join (select {keys}, quantile_cont(ret, {level}) as q from {source} group by {keys}) q on {on} where s.ret <= q.q group by {group}"


STRESSED = """stressed as (
  select ticker, 'Market Crash' as scenario, ret - 0.10::double as ret from {src} union all
  select ticker, 'High Volatility', ret * 2 from {src} union all
  select ticker, 'Prolonged Decline', case when row_number() over (partition by ticker order by ts desc) <= 30 then -0.02::double else ret end from {src} union all
  select ticker, 'Mixed Scenario', (ret - 0.05::double) * 1.5::double from {src})"""
YEAR_RETS = RETS.replace("bars as (select event_type", "all_bars as (select event_type").replace(
    ", rets as", ", bars as (select a.* from all_bars a join (select ticker, max(ts) as last from all_bars group by 1) l using (ticker) where ts >= last - interval 365 day), rets as"
)
PORTFOLIO = "folio as (select 'PORTFOLIO' as ticker, ts, avg(ret) as ret from rets group by ts)"
BOTH = f"{YEAR_RETS}, {PORTFOLIO}, both_rets as (select ticker, ts, ret from rets union all select ticker, ts, ret from folio)"
RS = (
    "(ln(nullif(high, 0) / nullif(open, 0)) * (ln(nullif(high, 0) / nullif(open, 0)) - ln(nullif(close, 0) / nullif(open, 0))) "
    "+ ln(nullif(low, 0) / nullif(open, 0)) * (ln(nullif(low, 0) / nullif(open, 0)) - ln(nullif(close, 0) / nullif(open, 0))))"
)
TERM = "(0.5 * ln(nullif(high, 0) / nullif(low, 0)) ^ 2 - (2 * ln(2) - 1) * ln(nullif(close, 0) / nullif(open, 0)) ^ 2)"
GK = f"{BARS}, terms as (select *, {TERM} as term, ln(close / nullif(lag(close) over (partition by ticker order by ts), 0)) as lr from bars)"
YZ = (
    f"{BARS}, y as (select ticker, ts, {RS} as rs, "
    "open / nullif(lag(open) over w, 0) - 1 as oo, close / nullif(lag(close) over w, 0) - 1 as cc from bars window w as (partition by ticker order by ts)), yy as (select *, cc - oo as co from y)"
)
GRID = (
    f"{BARS}, feats as (select ticker, " + ", ".join(f"case when count(close) over w{n} >= {n} then stddev_samp(close) over w{n} end as std_{n}" for n in corrgrid.WINDOWS)
    + ", " + ", ".join(f"lead(close, {d}) over o / close - 1 as fwd_{d}" for d in corrgrid.HORIZONS) + " from bars window o as (partition by ticker order by ts), "
    + ", ".join(f"w{n} as (partition by ticker order by ts rows between {n - 1} preceding and current row)" for n in corrgrid.WINDOWS) + "), grid as ("
    + " union all ".join(f'select ticker, {n} as "window", {d} as days, corr(std_{n}, fwd_{d}) as corr from feats group by ticker' for n in corrgrid.WINDOWS for d in corrgrid.HORIZONS) + ")"
)


def uniform_sql(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"((('0x' || substr(md5({text}), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0"


def normal_sql(*parts: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(chr(39) + 'a' + chr(39), *parts)})) * cos(2 * pi() * {uniform_sql(chr(39) + 'b' + chr(39), *parts)}))"


GBM = (
    f"{GK}, par as (select ticker, arg_max(close, ts) as s0, round(avg(lr) / (1.0::double / 26) + 0.5 * arg_max(gk, ts) ^ 2, 6) as mu, round(arg_max(gk, ts), 6) as sigma from (select *, case when count(term) over w >= 10 then sqrt(avg(term) over w) end as gk from terms "
    "window w as (partition by ticker order by ts rows between 9 preceding and current row)) group by ticker), "
    f"cells as (select ticker, round(s0, 6) as s0, mu, sigma, p.path::int as path, s.step::int as step from par, range({GBM_PATHS}) p(path), range(13) s(step)), "
    f"paths as (select ticker, path, step, s0 * exp((mu - 0.5 * sigma * sigma) * step * (0.5 / 12) + sigma * sum({normal_sql('ticker', 'path', 'step')} * sqrt(1.0::double / 26)) over (partition by ticker, path order by step)) as price from cells)"
)
WEEKLY_YZ = (
    f"{WEEKS}, y as (select ticker, date, close, ln(close / nullif(lag(close) over w, 0)) as lr, {RS} as rs, "
    "open / nullif(lag(open) over w, 0) - 1 as oo, close / nullif(lag(close) over w, 0) - 1 as cc from weeks window w as (partition by ticker order by date)), yy as (select *, cc - oo as co from y), "
)
GBM_YZ = f"with {WEEKLY_YZ}" + ", ".join(
    f"par{p} as (select ticker, round(arg_max(close, date), 6) as s0, round(avg(lr) / (1.0::double / {p}) + 0.5 * arg_max(yz, date) ^ 2, 6) as mu, round(arg_max(yz, date), 6) as sigma from (select *, case when least(count(oo) over w, count(rs) over w, count(co) over w) >= {n} then "
    f"sqrt((var_samp(oo) over w + {volatility.yang_zhang_weight(n)!r}::double * avg(rs) over w + (1 - {volatility.yang_zhang_weight(n)!r}::double) * var_samp(co) over w) * {p}) end as yz from yy window w as (partition by ticker order by date rows between {n - 1} preceding and current row)) group by ticker), "
    f"cells{p} as (select *, p.path::int as path, s.step::int as step from par{p}, range({GBM_PATHS}) p(path), range({p // 2}) s(step))"
    for n, p in ((5, 52), (10, 26))
) + " " + " union all ".join(
    f"select {p} as steps_a_year, ticker, path, step, round(ln(s0) + ((mu - 0.5 * sigma * sigma) * step * (0.5 / {p // 2 - 1}) + sigma * sum({normal_sql('ticker', 'path', 'step')} * sqrt(1.0::double / {p})) over (partition by ticker, path order by step)), 5) as log_price from cells{p}"
    for p in (52, 26)
)
SUMMARY = (
    "round(avg({x}), 4) as mean, round(quantile_cont({x}, 0.5), 4) as median, round(stddev_pop({x}), 4) as std, round(quantile_cont({x}, 0.05), 4) as p5, round(quantile_cont({x}, "
    "0.95), 4) as p95"
)
OU_FIT = (
    f"{BARS}, logs as (select ticker, ts, ln(close) as y, lag(ln(close)) over (partition by ticker order by ts) as x from bars), "
    "fit as (select ticker, arg_max(y, ts) as x0, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, avg(y - x) as mu, stddev_pop(y - x) as sigma from logs group by ticker)"
)
OU = (
    f"with recursive {OU_FIT}, start as (select ticker, round(x0, 7) as x0, round(mu, 7) as mu, round(sigma, 7) as sigma, round((1 - slope) * 252, 7) as theta, p.path::int as path from fit, range({OU_PATHS}) p(path)), "
    "walk as (select ticker, path, mu, sigma, theta, 0 as step, x0 as x from start union all "
    f"select ticker, path, mu, sigma, theta, step + 1, x + theta * (mu - x) * (1.0::double / 252) + sigma * sqrt(1.0::double / 252) * {normal_sql('ticker', 'path', 'step')} from walk where step < {OU_STEPS})"
)
FILTER = (
    f"with recursive {RETS}, es as (select ticker, ts, ret, ret - avg(ret) over (partition by ticker) as e, var_pop(ret) over (partition by ticker) as h0, row_number() over (partition by ticker order by ts) as n from rets), "
    "rec as (select ticker, ts, n, e, h0 as h from es where n = 1 union all "
    f"select s.ticker, s.ts, s.n, s.e, {OMEGA}::double + {ALPHA}::double * r.e * r.e + {BETA}::double * r.h from rec r join es s on s.ticker = r.ticker and s.n = r.n + 1), "
    f"fc as (select ticker, k.step::int as step, {OMEGA}::double / (1 - ({ALPHA}::double + {BETA}::double)) + pow({ALPHA}::double + {BETA}::double, k.step - 1) * (h1 - {OMEGA}::double / (1 - ({ALPHA}::double + {BETA}::double))) as variance "
    f"from (select ticker, {OMEGA}::double + {ALPHA}::double * arg_max(e, n) ^ 2 + {BETA}::double * arg_max(h, n) as h1 from rec group by ticker), range(1, 15) k(step))"
)
EWMA = FILTER.replace(f"{OMEGA}::double + {ALPHA}::double * r.e * r.e + {BETA}::double * r.h", "(1 - 0.94::double) * r.e * r.e + 0.94::double * r.h")
POSTERIOR = (
    f"{BARS}, ranked as (select *, row_number() over (partition by ticker order by ts desc) as k from bars), post as (select *, (prior_mean / prior_std ^ 2 + prior_mean / like_std ^ 2) / (1 / prior_std ^ 2 + 1 / like_std ^ 2) as post_mean, "
    "sqrt(1 / (1 / prior_std ^ 2 + 1 / like_std ^ 2)) as post_std from (select ticker, arg_max(close, ts) as prior_mean, stddev_pop(close) as prior_std, sqrt(avg(high - low) filter (where k <= 7)) as like_std from ranked group by ticker))"
)
Z05 = normal.quantile(1 - 0.95)
DENSITY = normal.standard_density(Z05) / (1 - 0.95)


def _ratio(parts: tuple, x: str) -> str:
    """The quotient of two polynomials, from the largest power."""
    sums = [" + ".join(f"{c!r}::double * pow({x}, {len(p) - 1 - k})" for k, c in enumerate(p)) for p in parts]
    return f"(({sums[0]}) / ({sums[1]}))"


#: Partial autocorrelations by the Durbin-Levinson recursion over lists: r holds the autocorrelations, phi the last order's coefficients.
PACF = (
    "r as (select ticker, list(acf order by lag) as r from acf group by ticker), lev as (select ticker, r, 1 as lag, [r[1]] as phi, r[1] as pacf from r union all "
    "select ticker, r, lag + 1, list_concat(list_transform(range(1, lag + 1), lambda j: phi[j] - last * phi[lag + 1 - j]), [last]), last from (select *, "
    "(r[lag + 1] - list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[lag + 1 - j]))) / (1 - list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[j]))) as last from lev where lag < 20))"
)


def _pdf(mean: str, std: str) -> str:
    return f"exp(-(((x - {mean}) / {std}) ^ 2) / 2) / (sqrt(2 * pi()) * {std})"


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
ORACLES = {
    "q_bars_ohlc": f"with {BARS} select * from bars",
    "q_bars_weekly": f"with {WEEKS} select * from weeks",
    "q_simple_return": f"with {RETS} select ticker, ts, round(ret, 8) as ret from rets",
    "q_log_return": f"with {LOG_RETS} select ticker, ts, round(lr, 8) as log_ret from lrets where lr is not null",
    "q_forward_return": f"with {BARS} select ticker, ts, " + ", ".join(f"round(lead(close, {d}) over w / nullif(close, 0) - 1, 8) as fwd_{d}" for d in (1, 5, 14)) + " from bars window w as (partition by ticker order by ts)",
    "q_annualized_return": f"with {RETS} select ticker, ts, round(ret * sqrt(252), 7) as ret from rets",
    "q_var_hist": f"with {RETS} {_var_sql('rets')}",
    "q_var_param": (
        f"with {RETS}, f as (select ticker, avg(ret * sqrt(252)) as mu, stddev_samp(ret * sqrt(252)) as sd from rets group by ticker) select ticker, round(-(mu "
        f"+ {Z05!r}::double * sd), 6) as var, round(-(mu + sd * {DENSITY!r}::double), 6) as cvar, round(-mu + sd * {DENSITY!r}::double, 6) as cvar_textbook from "
        "f"
    ),
    "q_var_lookback": (
        f"with {WEEKS}, near as (select w.* from weeks w join (select ticker, max(date) as last from weeks group by 1) l using (ticker) where date >= last - 365), "
        "rets as (select * from (select ticker, date, close / nullif(lag(close) over (partition by ticker order by date), 0) - 1 as ret from near) where ret is "
        f"not null) {_var_sql('rets')}"
    ),
    "q_var_multi_confidence": f"with {RETS} " + " union all ".join(f"select *, {c}::double as confidence from ({_var_sql('rets', level=f'1 - {c}::double')})" for c in (0.9, 0.95, 0.99)),
    "q_stress_scenarios": f"with {RETS}, {STRESSED.format(src='rets')} {_var_sql('stressed', 'ticker, scenario')}",
    "q_stress_tail_only": (
        f"with {RETS}, {STRESSED.format(src='rets')} select ticker, scenario, count(*) as n, round(avg(ret), 6) as mean_ret, round(min(ret), 6) as min_ret from "
        "stressed where scenario = 'Prolonged Decline' group by all"
    ),
    "q_scenario_table": (
        f"with {RETS}, c as (select ticker, count(*) as rows from rets group by ticker), t as (select * from (values ('Market Crash', -0.1::double, null::double, null::int, null::double), "
        "('High Volatility', null, 2, null, null), ('Prolonged Decline', null, null, 30, -0.02), ('Mixed Scenario', -0.05, 1.5, null, null)) t(scenario, shock, vol_mult, tail_days, tail_return)) "
        "select ticker, rows, scenario, shock, vol_mult, tail_days, tail_return, least(rows, coalesce(tail_days, 0)) as replaced, case when shock is not null or vol_mult is not null then rows else 0 end as shifted from c, t"
    ),
    "q_portfolio_return": f"with {RETS}, {PORTFOLIO} select ticker, ts, round(ret, 8) as ret from folio",
    "q_portfolio_var": f"with {RETS}, {PORTFOLIO} {_var_sql('folio')}",
    "q_portfolio_stress": f"with {RETS}, {PORTFOLIO}, {STRESSED.format(src='folio')} {_var_sql('stressed', 'ticker, scenario')}",
    "q_risk_report": (
        f"with {BOTH}, {STRESSED.format(src='both_rets')}, v as (select ticker, '' as scenario, var, cvar from ({_var_sql('both_rets')}) union all select ticker, "
        f"scenario, var, cvar from ({_var_sql('stressed', 'ticker, scenario')})) select case when ticker = 'PORTFOLIO' then 0 else 1 end as section, ticker, scenario, "
        "printf('VaR (95%%): %.4f  cVaR (95%%): %.4f', var, cvar) as line from v"
    ),
    "q_rolling_var": (
        f"with {RETS} select ticker, ts, round(ret, 6) as ret, round(case when count(ret) over w >= 60 then -quantile_cont(ret, 1 - 0.95::double) over w end, 6) "
        "as var from rets window w as (partition by ticker order by ts rows between 60 preceding and 1 preceding)"
    ),
    "q_back_test": (
        f"with {RETS}, r as (select ticker, ret, case when count(ret) over w >= 60 then -quantile_cont(ret, 1 - 0.95::double) over w end as var from rets window "
        "w as (partition by ticker order by ts rows between 60 preceding and 1 preceding)) select ticker, count(*) as days, (count(*) filter (where ret < -var))::bigint "
        "as breaches, round(count(*) * (1 - 0.95::double), 6) as expected from r where var is not null group by ticker"
    ),
    "q_roll_std": f"with {BARS} " + _frames("stddev_samp({x})", (3, 7, 14), "std", "close"),
    "q_roll_mean_15_30_45": f"with {BARS} " + _frames("avg({x})", (15, 30, 45), "avg", "close"),
    "q_gk_vol": f"with {GK} select ticker, ts, " + ", ".join(f"round(case when count(term) over w{n} >= {n} then sqrt(greatest(0, avg(term) over w{n})) end, 6) as gk_{n}" for n in (30, 10, 5)) + " from terms window " + ", ".join(f"w{n} as (partition by ticker order by ts rows between {n - 1} preceding and current row)" for n in (30, 10, 5)),
    "q_yz_vol": f"with {YZ} select ticker, ts, " + ", ".join(f"round(case when least(count(oo) over w{n}, count(rs) over w{n}, count(co) over w{n}) >= {n} then sqrt((var_samp(oo) over w{n} + {volatility.yang_zhang_weight(n)!r}::double * avg(rs) over w{n} + (1 - {volatility.yang_zhang_weight(n)!r}::double) * var_samp(co) over w{n}) * {p}) end, 6) as yz_{n}" for n, p in ((5, 52), (10, 26))) + " from yy window " + ", ".join(f"w{n} as (partition by ticker order by ts rows between {n - 1} preceding and current row)" for n in (5, 10)),
    "q_gbm_params": (
        f"with {GK}, g as (select *, case when count(term) over w >= 10 then sqrt(avg(term) over w) end as gk from terms window w as (partition by ticker order "
        "by ts rows between 9 preceding and current row)) select ticker, round(arg_max(close, ts), 6) as s0, round(avg(lr) / (1.0::double / 26) + 0.5 * arg_max(gk, "
        "ts) ^ 2, 6) as mu, round(arg_max(gk, ts), 6) as sigma, round(0.5 * arg_max(gk, ts) ^ 2, 6) as mu_literal from g group by ticker"
    ),
    "q_corr_grid": f'with {GRID} select ticker, "window", days, round(corr, 6) as corr from grid',
    "q_corr_best": f'with {GRID} select ticker, "window", days, round(corr, 6) as corr from grid qualify row_number() over (partition by ticker order by corr desc nulls last, "window", days) = 1',
    "q_corr_matrix": f'with {GRID} select ticker, "window", ' + ", ".join(f"round(max(case when days = {d} then corr end), 6) as days_{d}" for d in corrgrid.HORIZONS) + " from grid group by all",
    "q_corr_row_mean": f'with {GRID} select ticker, "window", round(avg(corr), 6) as mean_corr from grid group by all',
    "q_gbm_paths": f"with {GBM} select ticker, path, step, round(price, 4) as price from paths",
    "q_gbm_mean_path": f"with {GBM} select ticker, step, round(avg(price), 4) as mean_price from paths group by all",
    "q_gbm_final_stats": f"with {GBM} select ticker, {SUMMARY.format(x='price')} from paths where step = 12 group by ticker",
    "q_mc_histogram": (
        f"with {GBM}, l as (select ticker, round(price, 4) as price from paths where step = 12), e as (select ticker, min(price) as lo, max(price) as hi from l "
        "group by ticker), b as (select ticker, lo, (hi - lo) / 20 as width, least(19, floor((price - lo) / ((hi - lo) / 20)))::int as bin from l join e using "
        "(ticker)) select ticker, bin, round(lo + bin * width, 4) as lower, round(lo + (bin + 1) * width, 4) as upper, count(*) as n from b group by ticker, bin, "
        "lo, width"
    ),
    "q_kernel_density": (
        f"with {RETS}, f as (select ticker, min(ret) as lo, max(ret) as hi, stddev_samp(ret) * pow(count(ret), -0.2) as h, count(ret) as n from rets group by ticker), "
        "g as (select ticker, lo, hi, h, n, i.i, lo + (hi - lo) * i.i / 19 as x from f, range(20) i(i)) select g.ticker as ticker, round(x, 6) as x, round(sum(exp(-(((x "
        "- ret) / h) ^ 2) / 2) / (sqrt(2 * pi()) * h)) / min(n), 6) as density from g join rets on g.ticker = rets.ticker group by g.ticker, i, x"
    ),
    "q_gbm_yz_paths": GBM_YZ,
    "q_ou_mean_path": f"{OU} select ticker, step, round(avg(exp(x)), 4) as mean_price from walk group by all",
    "q_ou_final_stats": f"{OU} select ticker, {SUMMARY.format(x='exp(x)')} from walk where step = {OU_STEPS} group by ticker",
    "q_ou_paths": f"{OU} select ticker, path, count(*) as points, round(min(x), 4) as low, round(max(x), 4) as high, round(arg_max(x, step), 4) as x_final from walk group by all",
    "q_bayes_posterior": f"with {POSTERIOR} select ticker, " + ", ".join(f"round({c}, 6) as {c}" for c in ("prior_mean", "prior_std", "like_std", "post_mean", "post_std")) + " from post",
    "q_bayes_grid": (
        f"with {POSTERIOR}, g as (select *, g.i::int as n, prior_mean + prior_std * (6.0::double * g.i / 999 - 3) as x from post, range(1000) g(i)) select ticker, "
        f"n as i, round(x, 7) as x, round({_pdf('prior_mean', 'prior_std')}, 7) as prior, round({_pdf('prior_mean', 'like_std')}, 7) as likelihood, round({_pdf('post_mean', 'post_std')}, "
        "7) as posterior from g"
    ),
    "q_ar1_ou_fit": (
        f"with {OU_FIT} select ticker, round(x0, 6) as x0, round(slope, 6) as slope, round(intercept, 6) as intercept, round(case when slope > 0 then -ln(slope) "
        "* 252 end, 6) as theta, round((1 - slope) * 252, 6) as theta_euler, round(mu, 6) as mu, round(sigma, 6) as sigma from fit"
    ),
    "q_acf": f"with {RETS}, c as (select ticker, ts, ret - avg(ret) over (partition by ticker) as x from rets) " + " union all ".join(f"select ticker, {k} as lag, round(sum(p) / sum(x * x), 6) as acf from (select ticker, x, x * lag(x, {k}) over (partition by ticker order by ts) as p from c) group by ticker" for k in range(1, 21)),
    "q_pacf": f"with recursive {RETS}, c as (select ticker, ts, ret - avg(ret) over (partition by ticker) as x from rets), acf as (" + " union all ".join(f"select ticker, {k} as lag, sum(p) / sum(x * x) as acf from (select ticker, x, x * lag(x, {k}) over (partition by ticker order by ts) as p from c) group by ticker" for k in range(1, 21)) + f"), {PACF} select ticker, lag, round(pacf, 6) as pacf from lev",
    "q_df_test": (
        f"with {RETS}, l as (select ticker, ret as y, lag(ret) over (partition by ticker order by ts) as x from rets), f as (select ticker, count(*) as n, regr_slope(y "
        "- x, x) as g, regr_sxx(y - x, x) as sxx, regr_syy(y - x, x) as syy, regr_sxy(y - x, x) as sxy from l where x is not null group by ticker) select ticker, "
        "n, round(g, 6) as gamma, round(g / sqrt((syy - g * sxy) / (n - 2) / sxx), 6) as t from f"
    ),
    "q_garch_filter": f"{FILTER} select ticker, ts, round(h, 6) as variance from rec",
    "q_std_resid": f"{FILTER} select ticker, ts, round(e / sqrt(h), 6) as std_resid from rec",
    "q_garch_forecast": f"{FILTER} select ticker, step, round(variance, 6) as variance from fc",
    "q_mse_rmse": (
        f"{FILTER}, seen as (select ticker, 15 - row_number() over (partition by ticker order by ts desc) as step, ret * ret as s from rets qualify step >= 1) select "
        "seen.ticker as ticker, round(avg((s - variance) ^ 2), 5) as mse, round(sqrt(avg((s - variance) ^ 2)), 5) as rmse, round(avg(abs(s - variance)), 5) as "
        "mae from seen join fc on seen.ticker = fc.ticker and seen.step = fc.step group by seen.ticker"
    ),
    "q_qq_pairs": (
        f"{FILTER}, z as (select ticker, e / sqrt(h) as sample, row_number() over (partition by ticker order by e / sqrt(h), ts) as i, count(*) over (partition "
        "by ticker) as n from rec), t as (select *, (i - 0.5::double) / n as p, (i - 0.5::double) / n - 0.5 as q, sqrt(-2 * ln(least((i - 0.5::double) / n, 1 - "
        f"(i - 0.5::double) / n))) as t from z), v as (select *, {_ratio(normal.TAIL, 't')} as tail, q * {_ratio(normal.MIDDLE, 'q * q')} as middle from t) select "
        f"ticker, i::int as i, round(case when least(p, 1 - p) >= {normal.TAIL_FROM}::double then middle when p < 0.5 then tail else -tail end, 4) as theoretical, "
        "round(sample, 4) as sample from v"
    ),
    "q_risk_report_document": (
        f"with {BOTH}, {STRESSED.format(src='both_rets')}, v as (select ticker, '' as scenario, var, cvar from ({_var_sql('both_rets')}) union all select ticker, "
        f"scenario, var, cvar from ({_var_sql('stressed', 'ticker, scenario')})) select case when ticker = 'PORTFOLIO' then 0 else 1 end as section, ticker, ticker "
        "|| ':' || chr(10) || string_agg(case when scenario = '' then '' else '  ' || scenario || ': ' end || printf('VaR (95%%): %.4f  cVaR (95%%): %.4f', var, "
        "cvar), chr(10) order by scenario) as text from v group by ticker"
    ),
    "q_ewma": f"{EWMA} select ticker, ts, round(h, 6) as variance from rec",
}
