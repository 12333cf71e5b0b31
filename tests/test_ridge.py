"""The fit against an SVD form with direct residuals; the recursion against a plain loop."""

import numpy as np
import pytest

from stockcast.functions.ridge import fit_batch, recurse_batch

P = 7


def svd_fit(z, y):
    n = len(y)
    yc = y - y.mean()
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    alpha, lam, old = 1.0 / (np.var(y) + np.finfo(float).eps), 1.0, None
    for step in range(300):
        coef = vt.T @ ((s * (u.T @ yc)) / (s**2 + lam / alpha))
        sse = np.sum((yc - z @ coef) ** 2)
        gamma = np.sum(alpha * s**2 / (lam + alpha * s**2))
        lam = (gamma + 2e-6) / (coef @ coef + 2e-6)
        alpha = (n - gamma + 2e-6) / (sse + 2e-6)
        if step and np.sum(np.abs(old - coef)) < 1e-3:
            break
        old = coef
    coef = vt.T @ ((s * (u.T @ yc)) / (s**2 + lam / alpha))
    return coef, vt.T @ np.diag(1.0 / (alpha * s**2 + lam)) @ vt, alpha, step + 1


def series(kind, n, rng):
    t = np.arange(n)
    y = {
        "linear": 100.0 + t,
        "noisy": 50 + 0.1 * t + rng.normal(0, 10, n),
        "weekly": 80.0 + 5 * (t % 7),
        "pulse": 100 + t + 40 * np.exp(-np.abs(t - n / 2) / 3),
    }[kind]
    x = np.column_stack([
        t[7:], t[7:] % 7, np.exp(-np.abs(t[7:] - n / 2) / 9), y[6:-1], y[:-7],
        [y[i - 6:i + 1].mean() for i in range(7, n)], [y[i - 6:i + 1].std(ddof=1) for i in range(7, n)],
    ])
    sd = x.std(axis=0)
    sd[sd < 1e-9] = 1.0
    return (x - x.mean(axis=0)) / sd, y[7:]


@pytest.mark.parametrize("kind", ["linear", "noisy", "weekly", "pulse"])
@pytest.mark.parametrize("n", [60, 400])
def test_fit_agrees_with_svd_form(kind, n):
    z, y = series(kind, n, np.random.default_rng(7))
    yc = y - y.mean()
    got = fit_batch(np.array([float(len(y))]), (z.T @ z)[None], (z.T @ yc)[None], np.array([yc @ yc]))
    coef, sigma, alpha, passes = svd_fit(z, y)
    np.testing.assert_allclose(z @ got["coef"][0], z @ coef, atol=1e-8)
    std = lambda s, a: np.sqrt(np.sum(z @ s * z, axis=1) + 1 / a)
    np.testing.assert_allclose(std(got["sigma"][0], got["alpha"][0]), std(sigma, alpha), rtol=1e-5, atol=1e-7)
    if kind in ("noisy", "pulse"):  # without noise the residual is rounding error, and so is the stopping pass
        assert got["passes"][0] == passes


def test_batch_equals_single_fits():
    rng = np.random.default_rng(3)
    data = [series(k, n, rng) for k, n in (("noisy", 50), ("linear", 90), ("weekly", 200))]
    stats = [(float(len(y)), z.T @ z, z.T @ (y - y.mean()), np.sum((y - y.mean()) ** 2)) for z, y in data]
    together = fit_batch(*(np.array(column) for column in zip(*stats)))
    for i, s in enumerate(stats):
        alone = fit_batch(*(np.array([v]) for v in s))
        np.testing.assert_allclose(together["coef"][i], alone["coef"][0], rtol=1e-9, atol=1e-12)


def test_known_coefficients_are_recovered():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(5000, P))
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    true = np.array([5.0, -3.0, 0.0, 2.0, 1.0, -1.0, 0.5])
    y = z @ true + rng.normal(0, 0.5, 5000)
    yc = y - y.mean()
    got = fit_batch(np.array([5000.0]), (z.T @ z)[None], (z.T @ yc)[None], np.array([yc @ yc]))
    np.testing.assert_allclose(got["coef"][0], true, atol=0.05)
    assert got["alpha"][0] == pytest.approx(4.0, rel=0.1)


def test_recursion_agrees_with_plain_loop():
    rng = np.random.default_rng(5)
    batch, days = 3, 20
    coef = rng.normal(size=(batch, P))
    root = rng.normal(size=(batch, P, P)) * 0.1
    sigma = root @ root.transpose(0, 2, 1)
    alpha, intercept = rng.uniform(0.01, 1, batch), rng.uniform(20, 60, batch)
    means, scales = rng.uniform(1, 40, (batch, P)), rng.uniform(5, 20, (batch, P))
    tail, index = rng.uniform(10, 90, (batch, 7)), np.array([30.0, 99.0, 7.0])
    weekdays, scores = rng.integers(0, 7, (batch, days)).astype(float), rng.uniform(0, 1, (batch, days))
    mean, low, high = recurse_batch(coef, sigma, alpha, intercept, means, scales, tail, index, weekdays, scores)
    for b in range(batch):
        known = list(tail[b])
        for i in range(days):
            last = known[-7:]
            x = np.array([index[b] + 1 + i, weekdays[b, i], scores[b, i], known[-1], known[-7], np.mean(last), np.std(last)])
            z = (x - means[b]) / scales[b]
            m, s = z @ coef[b] + intercept[b], np.sqrt(z @ sigma[b] @ z + 1 / alpha[b])
            np.testing.assert_allclose(
                [mean[b, i], low[b, i], high[b, i]], [max(m, 0), max(m - 1.96 * s, 0), max(m + 1.96 * s, 0)], rtol=1e-9
            )
            known.append(max(m, 0.0))
