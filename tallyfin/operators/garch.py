"""Maximum-likelihood fits of GARCH(1,1) to many series at once: series are the rows of one matrix, and each step of the search is taken for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix, steps of the search, and the fall of the objective under which a series has come to rest.
CELLS, STEPS, REST = 2_000_000, 200, 1e-10
#: alpha + beta stays under this.
MOST = 0.99989
#: Starting points (alpha, beta), with the constant that gives the series' own variance; those tried again where a parameter ends under EDGE.
EDGE, BESIDE = 1e-3, ((1e-6, 0.05), (1e-6, 0.5), (1e-6, 0.9))
STARTS = tuple((a, b) for a in (0.02, 0.05, 0.2, 0.4) for b in (0.1, 0.5, 0.75, 0.93) if a + b < 0.999)


def decayed(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """y[t] = beta y[t - 1] + x[t] along the rows of x, from y[-1] = 0; beta by row.

    In pieces of the square root of the length: all pieces at once, then what each hands on to the next.
    """
    s, n = x.shape
    wide = max(1, int(np.sqrt(n)))
    tall = -(-n // wide)
    y = np.zeros((s, tall, wide))
    y.reshape(s, -1)[:, :n] = x
    b = beta[:, None]
    for j in range(1, wide):
        y[:, :, j] += b * y[:, :, j - 1]
    powers = beta[:, None] ** np.arange(1, wide + 1)
    carry = np.zeros(s)
    for r in range(tall):
        if r:
            y[:, r] += powers * carry[:, None]
        carry = y[:, r, -1]
    return y.reshape(s, -1)[:, :n]


def _shift(x: np.ndarray, first: np.ndarray | float) -> np.ndarray:
    out = np.empty_like(x)
    out[:, 0], out[:, 1:] = first, x[:, :-1]
    return out


def variances(params: np.ndarray, e2: np.ndarray, h0: np.ndarray) -> np.ndarray:
    """h[0] = h0 and h[t] = omega + alpha e2[t - 1] + beta h[t - 1] by row."""
    omega, alpha, beta = params.T
    return decayed(_shift(omega[:, None] + alpha[:, None] * e2, h0), beta)


def objective(params: np.ndarray, e2: np.ndarray, h0: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ln h + e2 / h over the ``told`` cells, and their derivatives by omega, alpha and beta.

    The derivatives of h obey its own recursion with 1, e2 and h of the row before in place of the news.
    """
    h = variances(params, e2, h0)
    ratio = e2 / h
    value = ((np.log(h) + ratio) * told).sum(axis=1)
    weight = (1 - ratio) / h * told
    beta = params[:, 2]
    news = np.concatenate([_shift(np.ones_like(e2), 0.0), _shift(e2, 0.0), _shift(h, 0.0)])
    slopes = decayed(news, np.tile(beta, 3)).reshape(3, *e2.shape)
    return value, np.einsum("kst,st->sk", slopes, weight)


def _to_params(z: np.ndarray, h0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(omega, alpha, beta) of free numbers: omega as a power of e in units of the variance, alpha + beta and alpha's share of it by the logistic function; and the derivatives, z by parameter."""
    size = np.exp(np.clip(z[:, 0], -60, 60)) * h0
    both = MOST / (1 + np.exp(-np.clip(z[:, 1], -60, 60)))
    share = 1 / (1 + np.exp(-np.clip(z[:, 2], -60, 60)))
    params = np.stack([size, both * share, both * (1 - share)], axis=1)
    slope = np.zeros((len(z), 3, 3))
    d_both, d_share = both * (1 - both / MOST), both * share * (1 - share)
    slope[:, 0, 0] = size
    slope[:, 1, 1], slope[:, 1, 2] = d_both * share, d_both * (1 - share)
    slope[:, 2, 1], slope[:, 2, 2] = d_share, -d_share
    return params, slope


def _from_params(params: np.ndarray, h0: np.ndarray) -> np.ndarray:
    omega, alpha, beta = params.T
    both = (alpha + beta) / MOST
    return np.stack([np.log(omega / h0), np.log(both / (1 - both)), np.log(alpha / beta)], axis=1)


def _search(z: np.ndarray, e2: np.ndarray, h0: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, objective) reached from free numbers z.

    A quasi-Newton search (Broyden, Fletcher, Goldfarb and Shanno), halving steps until they
    lower the objective; every series has its own matrix and rests when it no longer gains.
    """

    def at(z: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        params, slope = _to_params(z, h0[which])
        value, by = objective(params, e2[which], h0[which], told[which])
        return value, np.einsum("sik,sk->si", slope, by)

    live = np.arange(len(z))
    value, grad = at(z, live)
    inverse = np.tile(np.eye(3), (len(z), 1, 1)) / np.maximum(1.0, np.abs(grad).max(axis=1))[:, None, None]
    idle = np.zeros(len(z), int)
    for _ in range(STEPS):
        step = -np.einsum("sij,sj->si", inverse[live], grad[live])
        slope = np.einsum("si,si->s", step, grad[live])
        lost = slope >= 0  # no way down: begin anew along the gradient
        step[lost] = -grad[live[lost]] / np.maximum(1.0, np.abs(grad[live[lost]]).max(axis=1))[:, None]
        inverse[live[lost]] = np.eye(3)
        slope = np.einsum("si,si->s", step, grad[live])
        step *= np.minimum(1.0, 4.0 / np.maximum(np.abs(step).max(axis=1), 1e-300))[:, None]
        scale, done = np.ones(len(live)), np.zeros(len(live), bool)
        new_z, new_value, new_grad = z[live].copy(), value[live].copy(), grad[live].copy()
        for _ in range(30):
            open_ = np.flatnonzero(~done)
            if not len(open_):
                break
            trial = z[live[open_]] + scale[open_, None] * step[open_]
            v, g = at(trial, live[open_])
            good = v <= value[live[open_]] + 1e-4 * scale[open_] * slope[open_]
            rows = open_[good]
            new_z[rows], new_value[rows], new_grad[rows], done[rows] = trial[good], v[good], g[good], True
            scale[open_[~good]] /= 2
        dz, dg = new_z - z[live], new_grad - grad[live]
        curve = np.einsum("si,si->s", dz, dg)
        turn = np.flatnonzero(curve > 1e-12)
        if len(turn):
            rho, s, y = 1 / curve[turn], dz[turn], dg[turn]
            left = np.eye(3)[None] - rho[:, None, None] * s[:, :, None] * y[:, None, :]
            inverse[live[turn]] = left @ inverse[live[turn]] @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        gained = value[live] - new_value
        z[live], value[live], grad[live] = new_z, new_value, new_grad
        still = gained <= REST * np.maximum(1.0, np.abs(new_value))
        inverse[live[still]] = np.eye(3) / np.maximum(1.0, np.abs(new_grad[still]).max(axis=1))[:, None, None]
        idle[live] = np.where(still, idle[live] + 1, 0)
        live = live[idle[live] < 2]  # at rest along the gradient as well
        if not len(live):
            break
    params, _ = _to_params(z, h0)
    return params, value


def fit_batch(series: list[np.ndarray]) -> np.ndarray:
    """Rows (omega, alpha, beta, objective) of series of squared residuals, each begun at its mean.

    The search starts from the best of STARTS, and again beside the edge for series that end there, where the
    free numbers of a parameter near 0 hardly move.
    """
    n = max(map(len, series))
    e2, told = np.zeros((len(series), n)), np.zeros((len(series), n))
    for i, x in enumerate(series):
        e2[i, : len(x)], told[i, : len(x)] = x, 1.0
    h0 = np.array([x.mean() for x in series])

    def begin(a: float, b: float, h: np.ndarray) -> np.ndarray:
        return np.stack([h * (1 - a - b), np.full(len(h), a), np.full(len(h), b)], axis=1)

    best, z = np.full(len(series), np.inf), np.zeros((len(series), 3))
    for a, b in STARTS:
        h = variances(begin(a, b, h0), e2, h0)
        value = ((np.log(h) + e2 / h) * told).sum(axis=1)
        better = value < best
        best[better], z[better] = value[better], _from_params(begin(a, b, h0), h0)[better]
    params, value = _search(z, e2, h0, told)
    edge = np.flatnonzero((params[:, 1:] < EDGE).any(axis=1))
    for a, b in BESIDE if len(edge) else ():
        again, reached = _search(_from_params(begin(a, b, h0[edge]), h0[edge]), e2[edge], h0[edge], told[edge])
        better = reached < value[edge]
        params[edge[better]], value[edge[better]] = again[better], reached[better]
    return np.concatenate([params, value[:, None]], axis=1)


def fit(df: DataFrame, value: str, order: str, keys: str, min_rows: int, cells: int = CELLS) -> DataFrame:
    """(keys, n, mu, omega, alpha, beta, objective) of percent returns, series of ``min_rows`` values or more that vary.

    A series is one row (its values in order); a task takes its rows in batches of like length, ``cells`` numbers at a
    time, so many short series cost few steps of Python and a long one is a batch of its own.
    """
    kind = dict(df.dtypes)[keys]
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    rows = df.filter(F.col(value).isNotNull()).groupBy(keys).agg(values.alias("vs")).filter(F.size("vs") >= min_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            series = [np.asarray(batch.column(1)[i].values.to_numpy(zero_copy_only=False), float) * 100 for i in range(batch.num_rows)]
            queue = sorted((i for i, r in enumerate(series) if r.var() > 0), key=lambda i: len(series[i]))
            while at < len(queue):
                end = at + 1
                while end < len(queue) and (end + 1 - at) * len(series[queue[end]]) <= cells:
                    end += 1
                chosen, at = queue[at:end], end
                found = fit_batch([(series[i] - series[i].mean()) ** 2 for i in chosen])
                cols = [batch.column(0).take(pa.array(chosen)), pa.array([len(series[i]) for i in chosen], pa.int64()), pa.array([series[i].mean() for i in chosen]), *(pa.array(found[:, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(cols, [keys, "n", "mu", "omega", "alpha", "beta", "objective"])

    return rows.mapInArrow(run, f"`{keys}` {kind}, n long, mu double, omega double, alpha double, beta double, objective double")
