"""Regimes against plain loops: smoothing by sums over the future, rounds of expectation-maximisation, planted regimes."""

import math

import numpy as np
import pytest

from tallyfin.operators import regimes


def density(x, m, d):
    return math.exp(-(((x - m) / d) ** 2) / 2) / (math.sqrt(2 * math.pi) * d)


def plain(xs, p):
    """(smoothed weights, moves, likelihood's logarithm) of one series by loops; None passes on."""
    calm_mean, calm_std, wild_mean, wild_std, calm_stay, wild_stay = p
    t = [[calm_stay, 1 - calm_stay], [1 - wild_stay, wild_stay]]
    d = [(1.0, 1.0) if x is None else (density(x, calm_mean, calm_std), density(x, wild_mean, wild_std)) for x in xs]
    forward, before, loglik, a = [], [], 0.0, (0.5, 0.5)
    for like in d:
        before.append(a)
        raw = [like[j] * (a[0] * t[0][j] + a[1] * t[1][j]) for j in (0, 1)]
        loglik += math.log(sum(raw))
        a = tuple(x / sum(raw) for x in raw)
        forward.append(a)
    back, b = [None] * len(xs), (0.5, 0.5)
    for i in reversed(range(len(xs))):
        back[i] = b
        raw = [sum(t[k][j] * d[i][j] * b[j] for j in (0, 1)) for k in (0, 1)]
        b = tuple(x / sum(raw) for x in raw)
    weights, moves = [], []
    for i in range(len(xs)):
        w = [forward[i][j] * back[i][j] for j in (0, 1)]
        weights.append([x / sum(w) for x in w])
        m = [[before[i][k] * t[k][j] * d[i][j] * back[i][j] for j in (0, 1)] for k in (0, 1)]
        total = sum(map(sum, m))
        moves.append([[x / total for x in row] for row in m])
    return weights, moves, loglik


def plain_round(xs, p):
    weights, moves, loglik = plain(xs, p)
    out = []
    for j in (0, 1):
        n = sum(w[j] for w in weights)
        mean = sum(w[j] * x for w, x in zip(weights, xs)) / n
        out += [mean, math.sqrt(sum(w[j] * (x - mean) ** 2 for w, x in zip(weights, xs)) / n)]
    m = np.sum(moves, axis=0)
    return [*out, m[0][0] / m[0].sum(), m[1][1] / m[1].sum()], loglik


def planted(seed, n):
    rng = np.random.default_rng(seed)
    wild, xs, states = False, [], []
    for _ in range(n):
        wild = rng.random() < (0.9 if wild else 0.04)
        states.append(wild)
        xs.append(float(rng.normal(-0.5, 4.0) if wild else rng.normal(0.3, 1.0)))
    return xs, states


def frame(spark, series):
    return spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "ticker string, ts int, ret double").repartition(3)


@pytest.mark.parametrize("blocks", [1, 7])
def test_smoothing_by_brute_force(spark, blocks):
    xs = planted(1, 150)[0]
    xs[40] = None
    xs[90] = 1e5  # of no density in either
    series = {"a": xs, "b": planted(2, 9)[0], None: planted(3, 40)[0], **{f"k{i}": planted(i, i)[0] for i in range(1, 6)}}
    got = {(r.ticker, r.ts): r.wild for r in regimes.smoothed(frame(spark, series), (0.0, 1.0), (0.0, 5.0), (0.95, 0.9), blocks=blocks).collect()}
    for k, values in series.items():
        weights = plain([None if x == 1e5 else x for x in values], (0.0, 1.0, 0.0, 5.0, 0.95, 0.9))[0]
        assert [got[k, i] for i in range(len(values))] == pytest.approx([w[1] for w in weights], abs=1e-9)
    with pytest.raises(ValueError):
        regimes.smoothed(frame(spark, series), (0.0, 1.0), (0.0, 5.0), (0.0, 0.9))


def test_rounds_equal_loops_and_the_likelihood_never_falls(spark):
    series = {"a": planted(5, 200)[0], "b": planted(6, 60)[0], "few": [1.0, 2.0], "same": [3.0] * 20}
    got = {r.ticker: r for r in regimes.fit(frame(spark, series), rounds=4, rest=0.0, blocks=3).collect()}
    assert set(got) == {"a", "b"}
    for k in got:
        xs = series[k]
        p = [np.mean(xs), 0.6 * np.std(xs), np.mean(xs), 1.6 * np.std(xs), 0.95, 0.9]
        likelihoods = []
        for _ in range(4):
            p, loglik = plain_round(xs, p)
            likelihoods.append(loglik)
        assert list(got[k].loglik) == pytest.approx(likelihoods) and [got[k][c] for c in regimes.PARAMS] == pytest.approx(p)
        assert all(b >= a - 1e-9 for a, b in zip(likelihoods, likelihoods[1:]))


def test_planted_regimes_are_found(spark):
    xs, states = planted(8, 3000)
    df = frame(spark, {"a": xs})
    found = regimes.fit(df, rounds=12, blocks=4).first()
    assert found.calm_mean == pytest.approx(0.3, abs=0.1) and found.calm_std == pytest.approx(1.0, abs=0.1)
    assert found.wild_mean == pytest.approx(-0.5, abs=0.5) and found.wild_std == pytest.approx(4.0, abs=0.4)
    assert found.calm_stay == pytest.approx(0.96, abs=0.02) and found.wild_stay == pytest.approx(0.9, abs=0.04)
    told = {r.ts: r.wild > 0.5 for r in regimes.smoothed(df, (found.calm_mean, found.calm_std), (found.wild_mean, found.wild_std), (found.calm_stay, found.wild_stay)).collect()}
    assert np.mean([told[i] == s for i, s in enumerate(states)]) > 0.9


def test_regimes_of_nothing(spark):
    df = frame(spark, {"a": [1.0]}).limit(0)
    assert regimes.fit(df, rounds=1).count() == 0 and regimes.smoothed(df, (0.0, 1.0), (0.0, 5.0), (0.9, 0.9)).count() == 0
