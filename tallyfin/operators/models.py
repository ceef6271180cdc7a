"""Bayesian, autoregressive and GARCH models; closed forms and ordered folds, and fits per series where an optimiser is needed."""

from __future__ import annotations

from collections.abc import Callable
from math import pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.functions import normal
from tallyfin.functions.blocks import Affine, Weights, scan_rows, with_moments
from tallyfin.functions.scan import scan
from tallyfin.functions.series import ordered
from tallyfin.operators import garch

#: Least observations for a GARCH fit, forecast steps.
MIN_ROWS, HORIZON = 30, 14


def tail(df: DataFrame, n: int, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """The last n rows of each key."""
    latest = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", latest).filter(F.col("_rank") <= n).drop("_rank")


def posterior(bars: DataFrame, days: int = 7, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, prior_mean, prior_std, like_std, post_mean, post_std): a normal prior by the last close and population deviation, a likelihood by the mean range of the last rows.

    The likelihood's variance is the mean high - low itself, and its mean is the prior's.
    """
    latest = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))
    spread = F.when(F.col("_rank") <= days, F.col("high") - F.col("low"))
    fit = bars.withColumn("_rank", latest).groupBy(keys).agg(F.max_by("close", order).alias("prior_mean"), F.stddev_pop("close").alias("prior_std"), F.sqrt(F.avg(spread)).alias("like_std"))
    a, b = F.try_divide(F.lit(1.0), F.col("prior_std") * F.col("prior_std")), F.try_divide(F.lit(1.0), F.col("like_std") * F.col("like_std"))
    mean = F.try_divide(F.col("prior_mean") * a + F.col("prior_mean") * b, a + b)
    return fit.select("*", mean.alias("post_mean"), F.sqrt(F.try_divide(F.lit(1.0), a + b)).alias("post_std"))


def posterior_grid(post: DataFrame, points: int = 1000, keys: str = "ticker") -> DataFrame:
    """(keys, i, x, prior, likelihood, posterior): densities from three prior deviations under to over the mean."""
    x = F.col("prior_mean") + F.col("prior_std") * (6.0 * F.col("i") / (points - 1) - 3.0)
    grid = post.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    d = normal.density
    return grid.select(
        keys, "i", "x", d(F.col("x"), F.col("prior_mean"), F.col("prior_std")).alias("prior"),
        d(F.col("x"), F.col("prior_mean"), F.col("like_std")).alias("likelihood"), d(F.col("x"), F.col("post_mean"), F.col("post_std")).alias("posterior"),
    )


def ou_fit(bars: DataFrame, periods_per_year: int = 252, price: str = "close", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, x0, slope, intercept, theta, theta_euler, mu, sigma): an autoregression of the log price; theta = -ln(slope) * periods a year, null for a slope of 0 or less.

    theta_euler = (1 - slope) * periods a year is the rate of Euler steps of that length, which
    reproduce the autoregression and so are stable for any slope within 1 either way.  mu and sigma are the log return's mean and population deviation.
    """
    w = ordered(keys, order)
    made = bars.select(keys, order, F.ln(price).alias("y")).withColumn("x", F.lag("y").over(w)).withColumn("r", F.col("y") - F.col("x"))
    fit = made.groupBy(keys).agg(
        F.max_by("y", order).alias("x0"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("r").alias("mu"), F.stddev_pop("r").alias("sigma")
    )
    theta = F.when(F.col("slope") > 0, -F.ln("slope") * periods_per_year)
    return fit.select(keys, "x0", "slope", "intercept", theta.alias("theta"), ((1 - F.col("slope")) * periods_per_year).alias("theta_euler"), "mu", "sigma")


def dickey_fuller(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, gamma, t): the lag-0 test with a constant: change on level, and gamma over its standard error."""
    w = ordered(keys, order)
    made = df.select(keys, order, F.col(value).alias("y")).withColumn("x", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("x"))
    fit = made.filter("x is not null").groupBy(keys).agg(
        F.count("*").alias("n"), F.regr_slope("d", "x").alias("gamma"), F.regr_sxx("d", "x").alias("_sxx"), F.regr_syy("d", "x").alias("_syy"), F.regr_sxy("d", "x").alias("_sxy")
    )
    residual = F.col("_syy") - F.col("gamma") * F.col("_sxy")
    error = F.sqrt(F.try_divide(residual / (F.col("n") - 2), F.col("_sxx")))
    return fit.select(keys, "n", "gamma", F.try_divide(F.col("gamma"), error).alias("t"))


#: MacKinnon's response surfaces (2010) of the test with a constant, in powers of 1 / n.
CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}


#: MacKinnon's surfaces (1994) of the test's p-value with a constant, as powers of t, below and above MIDDLE_T; outside ENDS it is 0 or 1.
P_SMALL, P_LARGE, MIDDLE_T, ENDS = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, (-18.83, 2.74)


def p_value(t: float) -> float:
    """The approximate probability of a test value this low or lower if the series has a unit root."""
    if not ENDS[0] <= t <= ENDS[1]:
        return np.nan if np.isnan(t) else float(t > ENDS[1])
    return NormalDist().cdf(sum(c * t**k for k, c in enumerate(P_SMALL if t <= MIDDLE_T else P_LARGE)))


def critical_value(level: str, n: int) -> float:
    return sum(c / n**k for k, c in enumerate(CRITICAL[level]))


def _augmented(y: np.ndarray, lags: int, skip: int) -> tuple[float, float, int]:
    """t of the level, Akaike's criterion, and the observations, of changes on the level before, a constant and ``lags`` changes; the first ``skip`` changes are left out."""
    d = np.diff(y)
    x = np.column_stack([y[skip:-1], *(d[skip - k : len(d) - k] for k in range(1, lags + 1)), np.ones(len(d) - skip)])
    b, *_ = np.linalg.lstsq(x, d[skip:], rcond=None)
    e = d[skip:] - x @ b
    n, k = x.shape
    error = np.sqrt(e @ e / (n - k) * np.linalg.pinv(x.T @ x)[0, 0])
    return float(b[0] / error) if error else np.nan, float(n * np.log(max(e @ e, 1e-300) / n) + 2 * k), n


def augmented_dickey_fuller(df: DataFrame, lags: int | None = None, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, n, lags, t, p, crit_1, crit_5, crit_10): the test with a constant and lagged changes.

    Without ``lags`` Akaike's criterion chooses among 0 to 12 (n / 100) ** 0.25, all judged on the same
    rows.  Series too short for their lags are left out.  A series is one task's work.
    """

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [keys, "n", "lags", "t", "p", "crit_1", "crit_5", "crit_10"]
        y = pdf.sort_values(order)[value].dropna().to_numpy(float)
        most = lags if lags is not None else max(0, min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 3))
        if len(y) < 2 * most + 5:
            return pd.DataFrame(columns=columns)
        chosen = most if lags is not None else min(range(most + 1), key=lambda k: _augmented(y, k, most)[1])
        t, _, n = _augmented(y, chosen, chosen)
        return pd.DataFrame([[pdf[keys].iloc[0], n, chosen, t, p_value(t), *(critical_value(c, n) for c in CRITICAL)]], columns=columns)

    return df.select(keys, order, value).groupBy(keys).applyInPandas(test, f"{keys} string, n long, lags int, t double, p double, crit_1 double, crit_5 double, crit_10 double")


def autocorrelation(df: DataFrame, lags: int = 20, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, lag, acf): lagged products over the sum of squares, about the whole series' mean."""
    w, whole = ordered(keys, order), Window.partitionBy(keys)
    made = df.select(keys, order, (F.col(value) - F.avg(value).over(whole)).alias("x"))
    products = made.select(keys, "x", *((F.col("x") * F.lag("x", k).over(w)).alias(f"p{k}") for k in range(1, lags + 1)))
    sums = products.groupBy(keys).agg(F.sum(F.col("x") * F.col("x")).alias("_ss"), *(F.sum(f"p{k}").alias(f"{k}") for k in range(1, lags + 1)))
    long = sums.unpivot([keys, "_ss"], [f"{k}" for k in range(1, lags + 1)], "lag", "_sum")
    return long.select(keys, F.col("lag").cast("int").alias("lag"), F.try_divide("_sum", "_ss").alias("acf"))


def partial_autocorrelation(acf: DataFrame, keys: str = "ticker") -> DataFrame:
    """(keys, lag, pacf) by the Durbin-Levinson recursion on each key's few autocorrelations."""

    def levinson(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r, phi, out = pdf["acf"].to_numpy(), np.zeros(0), []
        for k in range(len(r)):
            bottom = 1 - phi @ r[:k]
            last = (r[k] - phi @ r[:k][::-1]) / bottom if bottom else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({keys: pdf[keys], "lag": pdf["lag"], "pacf": out})

    return acf.select(keys, "lag", "acf").groupBy(keys).applyInPandas(levinson, f"{keys} string, lag int, pacf double")


def garch_filter(df: DataFrame, omega: float, alpha: float, beta: float, value: str = "ret", order: str = "ts", keys: str = "ticker", blocks: int | None = None) -> DataFrame:
    """(keys, order, resid, variance, std_resid) of fixed parameters; the first variance is the series' own.

    A row's variance is an affine map of the last one, so a series is scanned in blocks that many tasks
    take (``functions.blocks``).  Rows without a value pass their variance on and have no residual;
    rows of one moment are taken in order of their residuals.
    """
    return _affine_variances(df, lambda e: omega + alpha * e * e, beta, value, order, keys, blocks)


def gjr_filter(df: DataFrame, omega: float, alpha: float, gamma: float, beta: float, value: str = "ret", order: str = "ts", keys: str = "ticker", blocks: int | None = None) -> DataFrame:
    """As garch_filter, with gamma more on the square of a negative residual."""
    return _affine_variances(df, lambda e: omega + (alpha + F.when(e < 0, gamma).otherwise(0.0)) * e * e, beta, value, order, keys, blocks)


def egarch_filter(df: DataFrame, omega: float, alpha: float, gamma: float, beta: float, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """As garch_filter, on the logarithm of the variance: omega + alpha (|z| - E|z|) + gamma z + beta times the last.

    z divides by the variance itself, so steps do not compose as maps: a series is one row's array here.
    """

    def step(h: Column, e: Column) -> Column:
        z = e / F.sqrt(h)
        return F.exp(omega + alpha * (F.abs(z) - sqrt(2 / pi)) + gamma * z + beta * F.ln(h))

    return _variances(df, step, value, order, keys)


def garch_in_mean(df: DataFrame, omega: float, alpha: float, beta: float, premium: float, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """garch_filter's rows with expected: the mean that a premium on the variance gives each row."""
    return garch_filter(df, omega, alpha, beta, value, order, keys).withColumn("expected", premium * F.col("variance"))


def regime_filter(
    df: DataFrame, calm: tuple[float, float], wild: tuple[float, float], stay: tuple[float, float], value: str = "ret", order: str = "ts", keys: str = "ticker", blocks: int | None = None
) -> DataFrame:
    """(keys, order, wild): the probability, given the rows up to each, of the second of two normal regimes (mean, deviation) that stay with these probabilities; before the first row both are alike likely.

    A row's step is a 2 x 2 matrix, so series are scanned in blocks as by garch_filter.  A row without a value, or of no density in
    either regime, only moves the regimes on.
    """
    if not all(0 < p < 1 for p in stay):
        raise ValueError("a regime stays with a probability between 0 and 1")
    likely = [normal.density(F.col(value), F.lit(m), F.lit(d)) for m, d in (calm, wild)]
    told = F.coalesce(likely[0] + likely[1] > 0, F.lit(False))
    calm_like, wild_like = (F.when(told, x).otherwise(1.0) for x in likely)
    cells = {"_m00": calm_like * stay[0], "_m01": calm_like * (1 - stay[1]), "_m10": wild_like * (1 - stay[0]), "_m11": wild_like * stay[1]}
    made = df.select(keys, order, F.col(value).alias("_value"), *(c.alias(name) for name, c in cells.items()), F.lit(0.5).alias("_half"))
    found = scan_rows(made, Weights, list(cells), ["_half", "_half"], [keys], [order], ["calm", "wild"], carry=["_value"], blocks=blocks, after=True)
    return found.select(keys, order, "wild")


def _affine_variances(df: DataFrame, news: Callable[[Column], Column], beta: float, value: str, order: str, keys: str, blocks: int | None) -> DataFrame:
    """(keys, order, resid, variance, std_resid) of variances news(residual) + beta times the last, from the series' own."""
    moments = with_moments(df.select(keys, order, F.col(value).cast("double").alias("_value")), "_value", [keys], {"_mean": F.avg, "_h0": F.var_pop})
    e = F.col("_value") - F.col("_mean")
    made = moments.select(keys, order, e.alias("resid"), "_h0").select(
        "*", F.when(F.col("resid").isNull(), 1.0).otherwise(beta).alias("_a"), F.when(F.col("resid").isNull(), 0.0).otherwise(news(F.col("resid"))).alias("_b")
    )
    found = scan_rows(made, Affine, ["_a", "_b"], ["_h0"], [keys], [order], ["variance"], carry=["resid"], blocks=blocks)
    return found.select(keys, order, "resid", "variance", F.try_divide("resid", F.sqrt("variance")).alias("std_resid"))


def _variances(df: DataFrame, step: Callable[[Column, Column], Column], value: str, order: str, keys: str) -> DataFrame:
    """(keys, order, resid, variance, std_resid) of a recursion step(variance, residual) from the series' own variance."""
    whole = Window.partitionBy(keys)
    made = df.select(keys, order, (F.col(value) - F.avg(value).over(whole)).alias("e"), F.var_pop(value).over(whole).alias("h0"))
    arrays = made.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct(order, "e"))).alias("s"), F.first("h0").alias("h0"))
    folded = arrays.select(keys, "s", scan(F.col("s"), F.col("h0"), lambda h, x: step(h, x["e"])).alias("h"))
    rows = folded.select(keys, F.explode_outer(F.arrays_zip("s", F.slice("h", F.lit(1), F.size("s")).alias("h"))).alias("z"))
    e, h = F.col("z.s.e"), F.col("z.h")
    return rows.select(keys, F.col(f"z.s.{order}").alias(order), e.alias("resid"), h.alias("variance"), F.try_divide(e, F.sqrt(h)).alias("std_resid"))


def garch_forecast(filtered: DataFrame, omega: float, alpha: float, beta: float, horizon: int = HORIZON, order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, step, variance): the expected variance of the steps after the last row."""
    last = filtered.groupBy(keys).agg(F.max_by("resid", order).alias("e"), F.max_by("variance", order).alias("h"))
    first = omega + alpha * F.col("e") * F.col("e") + beta * F.col("h")
    persistence = alpha + beta
    steps = last.select(keys, first.alias("h1"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    decay = F.pow(F.lit(persistence), (F.col("step") - 1).cast("double"))
    long_run = omega / (1 - persistence)
    return steps.select(keys, "step", (long_run + decay * (F.col("h1") - long_run)).alias("variance"))


def garch_accuracy(rets: DataFrame, forecast: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, mse, rmse, mae): the forecast against the squared returns of as many last rows, in their order."""
    back = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))
    steps = forecast.groupBy(keys).agg(F.max("step").alias("_n"))
    seen = rets.withColumn("_back", back).join(steps, keys).filter(F.col("_back") <= F.col("_n"))
    seen = seen.select(keys, (F.col("_n") - F.col("_back") + 1).alias("step"), (F.col(value) * F.col(value)).alias("seen"))
    miss = F.col("seen") - F.col("variance")
    scored = seen.join(forecast, [keys, "step"]).groupBy(keys).agg(F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"))
    return scored.select(keys, "mse", F.sqrt("mse").alias("rmse"), "mae")


def garch_fit(df: DataFrame, value: str = "ret", order: str = "ts", keys: str = "ticker", min_rows: int = MIN_ROWS) -> DataFrame:
    """(keys, n, mu, omega, alpha, beta, objective) of percent returns, by maximum likelihood; series of under ``min_rows`` values, or without variation, are left out.

    Many series are fitted at once (``operators.garch``); alpha + beta < 1 holds throughout.
    """
    return garch.fit(df, value, order, keys, min_rows)


def quantile_pairs(filtered: DataFrame, keys: str = "ticker") -> DataFrame:
    """(keys, i, theoretical, sample): sorted standardised residuals beside normal quantiles at (i - 1/2) / n."""
    i = F.row_number().over(Window.partitionBy(keys).orderBy("std_resid", "ts"))
    n = F.count("*").over(Window.partitionBy(keys))
    placed = filtered.select(keys, "std_resid", i.alias("i"), n.alias("n"))
    return placed.select(keys, "i", normal.quantile_column((F.col("i") - 0.5) / F.col("n")).alias("theoretical"), F.col("std_resid").alias("sample"))


def ewma(df: DataFrame, decay: float = 0.94, value: str = "ret", order: str = "ts", keys: str = "ticker") -> DataFrame:
    """(keys, order, variance): exponentially weighted variance, a fixed-parameter fold."""
    return garch_filter(df, 0.0, 1 - decay, decay, value, order, keys).select(keys, order, "variance")


