"""The parts of the PU classifier against plain sums."""

import numpy as np
import pytest

from mixtura.llm import quality_pu as pu


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    d = len(pu.FEATURES)
    good = rng.random(600) < 0.4
    x = rng.normal(size=(600, d)) + good[:, None] * np.linspace(0.2, 1.0, d)
    positive = good & (rng.random(600) < 0.5)
    df = spark.createDataFrame([(r.tolist(), bool(p)) for r, p in zip(x, positive, strict=True)], "x array<double>, positive boolean").repartition(5)
    return x, positive, good, df, x.mean(0), x.std(0)


def softplus(z):
    return np.logaddexp(0, z)


def test_risk_and_its_derivatives_match_plain_sums(data):
    x, positive, _, df, mean, scale = data
    risk, rng = pu.Risk(df, mean, scale, 0.01), np.random.default_rng(1)
    w = rng.normal(size=risk.size) * 0.1
    h, prior = pu._hinged(x, mean, scale), 0.4
    plain = lambda w: softplus(h @ w).mean() - prior * (h @ w)[positive].mean() + 0.01 * w[1:] @ w[1:]
    r = risk.at(w)
    assert r["n"] == 600 and r["positives"] == positive.sum() and risk.value(w, r, prior) == pytest.approx(plain(w))
    # p E_P[l(f)] + E_U[l(-f)] - p E_P[l(-f)], unclipped
    z = h @ w
    assert plain(w) - 0.01 * w[1:] @ w[1:] == pytest.approx(prior * softplus(-z[positive]).mean() + softplus(z).mean() - prior * softplus(z[positive]).mean())
    assert r["minus_u"] == pytest.approx(softplus(z).mean()) and r["minus_p"] == pytest.approx(softplus(z[positive]).mean())
    gradient = r["g_u"] - prior * r["g_p"] + 0.02 * np.concatenate([[0], w[1:]])
    for j in range(0, risk.size, 5):
        e = np.zeros(risk.size)
        e[j] = 1e-6
        assert (plain(w + e) - plain(w - e)) / 2e-6 == pytest.approx(gradient[j], abs=1e-6)
    s = 1 / (1 + np.exp(-z))
    assert np.allclose(r["h"], (h * (s * (1 - s))[:, None]).T @ h / 600)


def test_newton_steps_reach_the_least_risk_that_stays_non_negative(data):
    x, positive, _, df, mean, scale = data
    risk = pu.Risk(df, mean, scale, 0.01)
    w = risk.least(0.4, np.zeros(risk.size), 10)
    r = risk.at(w)
    assert r["minus_u"] >= 0.4 * r["minus_p"] and risk.value(w, r, 0.4) < risk.value(np.zeros(risk.size), risk.at(np.zeros(risk.size)), 0.4)


def test_prior_is_the_least_ratio_of_shares(data):
    x, positive, good, df, mean, scale = data
    risk = pu.Risk(df, mean, scale, 0.01)
    w = risk.least(0.7, np.zeros(risk.size), 10)
    z = pu._hinged(x, mean, scale) @ w
    at = np.clip(((z + 20) / 40 * pu.BINS).astype(int), 0, pu.BINS - 1)
    best = np.inf
    for cut in range(pu.BINS):
        n_p, n_u = (at[positive] >= cut).sum(), (at >= cut).sum()
        p, u = n_p / positive.sum(), n_u / len(at)
        if p >= 0.3:
            best = min(best, u / p * (1 + np.sqrt((1 - p) / max(1, n_p) + (1 - u) / max(1, n_u))))
    found = pu._prior(df, mean, scale, w)
    assert found == pytest.approx(np.clip(best, 0.05, 0.98)) and abs(found - good.mean()) < 0.25
