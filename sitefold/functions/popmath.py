"""Closed-form population-genetic quantities that depend on sample sizes alone."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

NAN = float("nan")


@lru_cache(maxsize=4096)
def harmonics(n: int) -> tuple[float, float]:
    """a1 and a2: sums of 1/i and 1/i^2 for i below n."""
    i = np.arange(1, max(n, 1), dtype=float)
    return float((1 / i).sum()), float((1 / i**2).sum())


def _w_pi(k, n):
    return 2 * k * (n - k) / (n * (n - 1))


def _w_watterson(k, n):
    return np.full_like(k, 1 / harmonics(n)[0])


def _w_theta_h(k, n):
    return 2 * k**2 / (n * (n - 1))


def _w_theta_l(k, n):
    return k / (n - 1)


def _w_eta1(k, n):
    return (k == 1) / harmonics(n)[0]


def _w_eta1_star(k, n):
    return ((k == 1) | (k == n - 1)) / harmonics(n)[0]


def _w_minus_eta1(k, n):
    return (k >= 2) / (harmonics(n)[0] - 1) if n >= 3 else np.zeros_like(k)


def _w_minus_eta1_star(k, n):
    norm = harmonics(n)[0] - 1 - 1 / (n - 1) if n >= 4 else 0.0
    return ((k >= 2) & (k <= n - 2)) / norm if norm > 0 else np.zeros_like(k)


#: Weight of a segregating site of k derived alleles among n, by estimator.
WEIGHTS = {
    "pi": _w_pi,
    "watterson": _w_watterson,
    "theta_h": _w_theta_h,
    "theta_l": _w_theta_l,
    "eta1": _w_eta1,
    "eta1_star": _w_eta1_star,
    "minus_eta1": _w_minus_eta1,
    "minus_eta1_star": _w_minus_eta1_star,
}


def weight_vector(weights, n: int) -> np.ndarray:
    """Weights for k = 0..n by name or from a callable of n; zero where nothing segregates."""
    if callable(weights):
        return np.asarray(weights(n), float)
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights!r}")
    out = np.zeros(n + 1)
    if n >= 2:
        out[1:n] = WEIGHTS[weights](np.arange(1, n, dtype=float), n)
    return out


@lru_cache(maxsize=64)
def fu_covariance(n: int) -> np.ndarray:
    """Fu's (1995) covariances sigma_ij of the spectrum, (n-1) by (n-1)."""
    return fu_rows(n, 1, n)


def fu_rows(n: int, low: int, high: int) -> np.ndarray:
    """Rows ``low`` to ``high - 1`` of :func:`fu_covariance`."""
    h = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, n + 1))))
    an = h[n - 1]
    a = lambda i: h[i - 1]
    i = np.arange(1, n)
    beta = np.zeros(n + 2)
    beta[i] = 2 * n / ((n - i + 1) * (n - i)) * (an + 1 / n - a(i)) - 2 / (n - i)
    own = np.arange(low, high)
    out = np.zeros((len(own), n - 1))
    x, y = np.meshgrid(own, i, indexing="ij")
    hi, lo = np.maximum(x, y), np.minimum(x, y)
    below, equal, above = (hi != lo) & (hi + lo < n), (hi != lo) & (hi + lo == n), (hi != lo) & (hi + lo > n)
    out[below] = ((beta[hi + 1] - beta[hi]) / 2)[below]
    out[equal] = ((an - a(hi)) / (n - hi) + (an - a(lo)) / (n - lo) - (beta[hi] + beta[lo + 1]) / 2 - 1 / (hi * lo))[equal]
    out[above] = ((beta[lo] - beta[lo + 1]) / 2 - 1 / (hi * lo))[above]
    diag = np.where(2 * i < n, beta[i + 1], np.where(2 * i == n, 2 * (an - a(i)) / (n - i) - 1 / i**2, beta[i] - 1 / i**2))
    out[np.arange(len(own)), own - 1] = diag[own - 1]
    return out


def _quadratic(u: np.ndarray, n: int) -> float:
    """u' sigma u; of large cohorts by rows, since the matrix would take gigabytes."""
    step = max(1, (1 << 20) // n)
    if n <= step:
        return float(u @ fu_covariance(n) @ u)
    return float(sum(u[k - 1 : min(k + step, n) - 1] @ (fu_rows(n, k, min(k + step, n)) @ u) for k in range(1, n, step)))


def variance_coefficients(w1, w2, n: int) -> tuple[float, float]:
    """Achaz's (2009) alpha and beta for the difference of two estimators."""
    key = (w1, w2, n)
    if key not in _COEFFICIENTS or callable(w1) or callable(w2):
        k = np.arange(1, n, dtype=float)
        v = (weight_vector(w1, n)[1:n] - weight_vector(w2, n)[1:n]) / k
        u = k * v
        _COEFFICIENTS[key] = float((k * v * v).sum()), _quadratic(u, n)
    return _COEFFICIENTS[key]


_COEFFICIENTS: dict = {}


def neutrality_variance(w1, w2, n: int, s: float) -> float:
    a1, a2 = harmonics(n)
    alpha, beta = variance_coefficients(w1, w2, n)
    return alpha * s / a1 + beta * s * (s - 1) / (a1 * a1 + a2)


def neutrality_score(difference: float, w1, w2, n: int, s: float) -> float:
    """Difference over its null standard deviation; NaN below three sites or samples."""
    if s < 3 or n < 3:
        return NAN
    var = neutrality_variance(w1, w2, n, s)
    return difference / math.sqrt(var) if var > 0 else NAN


def projection_matrix(n_from: int, n_to: int) -> np.ndarray:
    """Hypergeometric chances of k of ``n_to`` from j of ``n_from``: (n_to + 1) by (n_from + 1)."""
    if n_to > n_from:
        raise ValueError("cannot project to a larger sample")
    total = math.comb(n_from, n_to)
    return np.array([[math.comb(j, k) * math.comb(n_from - j, n_to - k) / total for j in range(n_from + 1)] for k in range(n_to + 1)])


def project_sfs(sfs, n_from: int, n_to: int) -> np.ndarray:
    return projection_matrix(n_from, n_to) @ np.asarray(sfs, float)
