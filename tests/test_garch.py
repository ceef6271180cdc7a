"""Batched fits against a plain simplex search on the plain objective, and their derivatives against differences."""

import numpy as np
import pytest

from tallyfin.operators import garch, models


def plain_objective(params: np.ndarray, e2: np.ndarray, h0: float) -> float:
    omega, alpha, beta = params
    if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 0.9999:
        return np.inf
    h, total = h0, 0.0
    for x in e2:
        total += np.log(h) + x / h
        h = omega + alpha * x + beta * h
    return total


def descend(f, start: np.ndarray, scale: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Simplex search (Nelder and Mead)."""
    points = [start] + [start + np.eye(len(start))[i] * scale[i] for i in range(len(start))]
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda x: x[:2])
    for k in range(steps):
        (worst, _, w), centre = ranked[-1], np.mean([p for *_, p in ranked[:-1]], axis=0)
        trial = centre + (centre - w)
        value = f(trial)
        if value < ranked[0][0]:
            far = centre + 2 * (centre - w)
            if (v := f(far)) < value:
                trial, value = far, v
        elif value >= ranked[-2][0]:
            near = centre + 0.5 * ((trial if value < worst else w) - centre)
            if (v := f(near)) < min(value, worst):
                trial, value = near, v
            else:
                best = ranked[0][2]
                ranked = [ranked[0]] + [(f(q := best + 0.5 * (p - best)), 10 + i, q) for i, (*_, p) in enumerate(ranked[1:])]
                ranked.sort(key=lambda x: x[:2])
                continue
        ranked[-1] = (value, 100 + k, trial)
        ranked.sort(key=lambda x: x[:2])
        if ranked[-1][0] - ranked[0][0] < 1e-9:
            break
    return ranked[0][2], ranked[0][0]


def simulated(rng, n, omega, alpha, beta):
    h, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        e = np.sqrt(h) * rng.normal()
        out.append(e)
        h = omega + alpha * e * e + beta * h
    return np.array(out)


def test_fits_reach_the_optimum_of_the_plain_search():
    rng = np.random.default_rng(1)
    series = [simulated(rng, rng.integers(40, 500), 1.0, a, b) for a in (0.02, 0.1, 0.3) for b in (0.05, 0.5, 0.65) for _ in range(2)] + [rng.normal(size=100) for _ in range(4)] + [rng.standard_t(3, size=80) for _ in range(4)]
    squares = [(s - s.mean()) ** 2 for s in series]
    for x, (omega, alpha, beta, reached) in zip(squares, garch.fit_batch(squares)):
        f = lambda p, x=x: plain_objective(p, x, x.mean())
        starts = [np.array([x.mean() * (1 - a - b), a, b]) for a in (0.05, 0.2, 0.4) for b in (0.1, 0.5, 0.75) if a + b < 0.999]
        best = min(starts, key=f)
        _, plain = descend(f, best, np.array([0.1 * best[0], 0.05, -0.05]))
        assert reached <= plain + 1e-4 and f(np.array([omega, alpha, beta])) == pytest.approx(reached, abs=1e-8)
        assert omega > 0 and alpha >= 0 and beta >= 0 and alpha + beta < 1


def test_derivatives_by_differences():
    rng = np.random.default_rng(2)
    e2 = rng.normal(size=(5, 83)) ** 2
    told = np.ones_like(e2)
    told[2, 40:] = 0
    h0, params = e2.mean(axis=1), np.column_stack([rng.uniform(0.1, 1, 5), rng.uniform(0.05, 0.3, 5), rng.uniform(0.1, 0.6, 5)])
    value, by = garch.objective(params, e2, h0, told)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        up, down = garch.objective(params + step, e2, h0, told)[0], garch.objective(params - step, e2, h0, told)[0]
        assert np.allclose((up - down) / 2e-6, by[:, k], rtol=1e-4)
    assert np.allclose(value[:2], [plain_objective(p, x, h) for p, x, h in zip(params[:2], e2, h0)])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1001])
def test_decayed_sums(n):
    rng = np.random.default_rng(n)
    x, beta, want = rng.normal(size=(4, n)), np.array([0.0, 0.5, 0.99, 1.0]), []
    for row, b in zip(x, beta):
        y = 0.0
        want.append([y := b * y + v for v in row])
    assert np.allclose(garch.decayed(x, beta), want)


def test_series_of_all_kinds(spark):
    rng = np.random.default_rng(4)
    rows = [("few", i, 0.01 * i) for i in range(29)] + [("same", i, 0.5) for i in range(60)] + [(None, i, float(x)) for i, x in enumerate(rng.normal(0, 0.01, 45))]
    rows += [("gaps", i, None if i % 9 == 0 else float(x)) for i, x in enumerate(rng.normal(0, 0.01, 300))] + [(f"k{k}", i, float(x)) for k in range(30) for i, x in enumerate(rng.normal(0, 0.01, 30 + k))]
    df = spark.createDataFrame(rows, "ticker string, ts int, ret double").repartition(4)
    got = {r.ticker: r for r in models.garch_fit(df).collect()}
    assert set(got) == {None, "gaps", *(f"k{k}" for k in range(30))} and got["gaps"].n == 266 and got["k29"].n == 59
    one = {r.ticker: r for r in garch.fit(df.filter("ticker = 'k29'"), "ret", "ts", "ticker", 30, cells=1).collect()}["k29"]
    assert one.objective == pytest.approx(got["k29"].objective, abs=1e-6)
    assert models.garch_fit(df.limit(0)).count() == 0
