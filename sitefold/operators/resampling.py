"""Block jackknife and bootstrap over per-block values, which are few."""

from __future__ import annotations

import numpy as np


def _arrays(values) -> tuple[np.ndarray, ...]:
    parts = tuple(np.asarray(v) for v in values) if isinstance(values, tuple) else (np.asarray(values),)
    if len({len(p) for p in parts}) != 1:
        raise ValueError("values differ in length")
    return parts


def block_jackknife(values, statistic, *, weights=None):
    """Estimate, standard error and leave-one-out values; with weights, Busing's unequal blocks.

    ``values`` is an array, or a tuple of arrays for a statistic of several.
    """
    parts = _arrays(values)
    n = len(parts[0])
    if n < 2:
        return float(statistic(*parts)) if n else float("nan"), float("nan"), np.zeros(0)
    left_out = np.array([statistic(*(np.delete(p, k, axis=0) for p in parts)) for k in range(n)], float)
    if weights is None:
        mean = left_out.mean()
        return float(mean), float(np.sqrt((n - 1) / n * ((left_out - mean) ** 2).sum())), left_out
    w = np.asarray(weights, float)
    if len(w) != n or (w <= 0).any():
        raise ValueError("a positive weight is needed for each block")
    h, whole = w.sum() / w, float(statistic(*parts))
    pseudo = h * whole - (h - 1) * left_out
    estimate = pseudo.mean()
    return float(estimate), float(np.sqrt(((pseudo - estimate) ** 2 / (h - 1)).mean())), left_out


def block_bootstrap(values, statistic, *, n_replicates: int = 1000, rng=None):
    """Estimate, standard error and replicates from resampled blocks."""
    parts = _arrays(values)
    rng = np.random.default_rng(rng)
    n = len(parts[0])
    picks = rng.integers(0, n, (n_replicates, n))
    replicates = np.array([statistic(*(p[i] for p in parts)) for i in picks], float)
    return float(statistic(*parts)), float(replicates.std(ddof=1)), replicates
