"""Figures from collected results. matplotlib is only needed to draw."""

from __future__ import annotations

import numpy as np


def _axes(ax):
    if ax is not None:
        return ax
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib") from e
    return plt.subplots()[1]


def plot_sfs(s, ax=None, folded=False, scaled=False, clip_endpoints=True, log_scale=True, color=None, **kwargs):
    s = np.asarray(s)
    k = np.arange(len(s))[1:-1] if clip_endpoints and not folded else np.arange(len(s))[1:] if clip_endpoints else np.arange(len(s))
    ax = _axes(ax)
    ax.bar(k, s[k], color=color, **kwargs)
    if log_scale and not scaled:
        ax.set_yscale("log")
    ax.set_xlabel("minor allele count" if folded else "derived allele count")
    ax.set_ylabel("scaled sites" if scaled else "sites")
    return ax


def plot_joint_sfs(s, ax=None, log_scale=True, cmap="viridis", clip_endpoints=True, **kwargs):
    s = np.asarray(s, float)
    s = s[1:-1, 1:-1] if clip_endpoints else s
    ax = _axes(ax)
    ax.imshow(np.log10(s, out=np.full_like(s, np.nan), where=s > 0) if log_scale else s, origin="lower", cmap=cmap, **kwargs)
    return ax


def plot_pairwise_ld(r2, ax=None, cmap="Greys", vmin=0, vmax=1, positions=None, **kwargs):
    ax = _axes(ax)
    extent = None if positions is None else (positions[0], positions[-1], positions[-1], positions[0])
    ax.imshow(r2, cmap=cmap, vmin=vmin, vmax=vmax, extent=extent, **kwargs)
    return ax


def ld_decay_curve(distances, values, bins=50, percentile=50):
    """Middles of distance bins and the percentile of the values in each."""
    x, y = np.asarray(distances, float), np.asarray(values, float)
    edges = np.linspace(x.min(), x.max(), bins + 1)
    k = np.clip(np.searchsorted(edges, x, "right") - 1, 0, bins - 1)
    curve = np.array([np.nanpercentile(y[k == b], percentile) if (k == b).any() else np.nan for b in range(bins)])
    return (edges[1:] + edges[:-1]) / 2, curve


def plot_ld_decay(distances, r2_values, ax=None, bins=50, color=None, percentile=50, **kwargs):
    ax = _axes(ax)
    ax.plot(*ld_decay_curve(distances, r2_values, bins, percentile), color=color, **kwargs)
    return ax


def plot_pca(coords, ax=None, pc_x=0, pc_y=1, explained_variance=None, labels=None, s=20, alpha=0.8, **kwargs):
    ax, coords = _axes(ax), np.asarray(coords)
    for name in [None] if labels is None else sorted(set(labels)):
        at = slice(None) if name is None else np.asarray(labels) == name
        ax.scatter(coords[at, pc_x], coords[at, pc_y], s=s, alpha=alpha, label=name, **kwargs)
    for axis, k in ((ax.set_xlabel, pc_x), (ax.set_ylabel, pc_y)):
        axis(f"PC{k + 1}" + ("" if explained_variance is None else f" ({100 * explained_variance[k]:.1f}%)"))
    return ax


def plot_pairwise_distance(dist, ax=None, labels=None, cmap="viridis", **kwargs):
    d = np.asarray(dist, float)
    if d.ndim == 1:
        n = int((1 + np.sqrt(1 + 8 * len(d))) / 2)
        full = np.zeros((n, n))
        full[np.triu_indices(n, 1)] = d
        d = full + full.T
    ax = _axes(ax)
    ax.imshow(d, cmap=cmap, **kwargs)
    if labels is not None:
        ax.set_xticks(range(len(labels)), labels)
    return ax


def plot_windowed(window_start, values, ax=None, stat_name="", color=None, fill_alpha=0.15, **kwargs):
    ax = _axes(ax)
    ax.plot(window_start, values, color=color, **kwargs)
    ax.fill_between(window_start, values, alpha=fill_alpha, color=color)
    ax.set_ylabel(stat_name)
    return ax


def plot_windowed_panel(results, statistics=None, figsize=None, colors=None):
    import matplotlib.pyplot as plt

    names = statistics or [c for c in results.columns if c not in ("chrom", "start", "end", "center", "n_variants", "window_id")]
    fig, axes = plt.subplots(len(names), 1, figsize=figsize, sharex=True, squeeze=False)
    for k, (ax, name) in enumerate(zip(axes[:, 0], names)):
        plot_windowed(results["start"], results[name], ax, name, None if colors is None else colors[k % len(colors)])
    return fig, axes[:, 0]


def plot_haplotype_frequencies(freqs, ax=None, palette=None, singleton_color="white"):
    ax, f = _axes(ax), np.asarray(freqs)
    at = 0.0
    for k, x in enumerate(f):
        ax.bar(0, x, bottom=at, color=singleton_color if x == f.min() and k else None, edgecolor="black")
        at += x
    return ax


def plot_variant_locator(positions, ax=None, step=None, color=None):
    ax, p = _axes(ax), np.asarray(positions)
    k = np.arange(0, len(p), step or max(1, len(p) // 100))
    ax.vlines(p[k], 0, 1, color=color)
    return ax
