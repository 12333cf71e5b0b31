"""Batched numpy kernels: evidence maximisation and the forecast recursion.

Both work on a whole Arrow batch of series at once. The data a kernel sees per
series is a fixed number of values (the 7×7 Gram matrix, seven last days, one
horizon), never the history itself.

Method: MacKay, "Bayesian interpolation" (1992); Tipping, "Sparse Bayesian
learning" (2001).
"""

from __future__ import annotations

import numpy as np

# Stopping rule, hyper-priors and band width.
MAX_PASSES = 300
TOLERANCE = 1e-3
PRIOR = 1e-6
BAND = 1.96
LAST_DAYS = 7


def fit_batch(n: np.ndarray, gram: np.ndarray, xty: np.ndarray, yy: np.ndarray) -> dict[str, np.ndarray]:
    """Bayesian ridge per series from Gram statistics of scaled, centred data.

    n (B,), gram (B,p,p), xty (B,p), yy (B,). Series that have converged leave
    the loop; the others go on.
    """
    batch, p = xty.shape
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = np.einsum("bij,bi->bj", vectors, xty)
    alpha = 1.0 / (yy / n + np.finfo(float).eps)
    lam = np.ones(batch)
    coef = np.zeros((batch, p))
    passes = np.zeros(batch, dtype=np.int32)

    def solve(rows: np.ndarray) -> np.ndarray:
        shrunk = rotated[rows] / (values[rows] + (lam[rows] / alpha[rows])[:, None])
        return np.einsum("bij,bj->bi", vectors[rows], shrunk)

    active = np.arange(batch)
    for step in range(MAX_PASSES):
        if not len(active):
            break
        new = solve(active)
        fitted = np.einsum("bi,bij,bj->b", new, gram[active], new)
        sse = np.maximum(yy[active] - 2.0 * np.einsum("bi,bi->b", new, xty[active]) + fitted, 0.0)
        scaled = alpha[active][:, None] * values[active]
        gamma = np.sum(scaled / (lam[active][:, None] + scaled), axis=1)
        lam[active] = (gamma + 2.0 * PRIOR) / (np.sum(new**2, axis=1) + 2.0 * PRIOR)
        alpha[active] = (n[active] - gamma + 2.0 * PRIOR) / (sse + 2.0 * PRIOR)
        moved = np.sum(np.abs(coef[active] - new), axis=1)
        coef[active] = new
        passes[active] = step + 1
        if step:
            active = active[~(moved < TOLERANCE)]
    coef = solve(np.arange(batch))
    spread = 1.0 / (alpha[:, None] * values + lam[:, None])
    sigma = np.einsum("bij,bj,bkj->bik", vectors, spread, vectors)
    return {"coef": coef, "sigma": sigma, "alpha": alpha, "lam": lam, "passes": passes}


def recurse_batch(
    coef: np.ndarray, sigma: np.ndarray, alpha: np.ndarray, intercept: np.ndarray,
    means: np.ndarray, scales: np.ndarray, tail: np.ndarray,
    last_index: np.ndarray, weekdays: np.ndarray, scores: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Day-by-day forecast of a batch: each day's mean feeds the next days' lags.

    tail (B,7) holds the last seven days, weekdays and scores (B,days). The
    rolling deviation divides by n here (by n-1 in training), and the variance
    of earlier predictions is not carried forward.
    """
    batch, days = scores.shape
    series = np.concatenate([tail, np.empty((batch, days))], axis=1)
    mean, low, high = (np.empty((batch, days)) for _ in range(3))
    for day in range(days):
        window = series[:, day:day + LAST_DAYS]
        features = np.column_stack(
            [
                last_index + 1 + day, weekdays[:, day], scores[:, day],
                window[:, -1], window[:, 0], window.mean(axis=1), window.std(axis=1),
            ]
        )
        z = (features - means) / scales
        centre = np.einsum("bi,bi->b", z, coef) + intercept
        deviation = np.sqrt(np.einsum("bi,bij,bj->b", z, sigma, z) + 1.0 / alpha)
        mean[:, day] = np.maximum(centre, 0.0)
        low[:, day] = np.maximum(centre - BAND * deviation, 0.0)
        high[:, day] = np.maximum(centre + BAND * deviation, 0.0)
        series[:, LAST_DAYS + day] = mean[:, day]
    return mean, low, high
