"""Linkage disequilibrium between pairs of sites.

Pairs within a distance: the genome is cut into buckets as wide as the distance;
every variant goes to its own bucket and, as a partner, to the one before. A bucket
then holds all pairs it owns, and counts of all types come from matrix products.
Shuffled data are two rows per variant, never two per pair, and only what is asked
for leaves the task: pairs, or sums by bin.

All pairs: variants are cut into tiles by index, and a task gets two tiles.

Sites that don't segregate are left out before pairing wherever the statistic
does not need them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import twolocus
from ..functions.popmath import NAN
from .haplotypes import cluster_labels
from .panel import Panel, allele_matrix, dosage_rows, dosages

TILE = 512


# -- counting ---------------------------------------------------------------------


def _types(m: np.ndarray, kind: str) -> list[np.ndarray]:
    """Indicator matrices of a locus's states, highest first: alternative and reference, or dosages 2, 1, 0."""
    if kind == "hap":
        return [(m > 0).astype(np.float32), (m == 0).astype(np.float32)]
    return [(m == g).astype(np.float32) for g in (2, 1, 0)]


def pair_counts(a: np.ndarray, b: np.ndarray, kind: str = "hap") -> np.ndarray:
    """Sites of ``a`` by sites of ``b`` by types, over samples called at both."""
    return np.stack([x @ y.T for x in _types(a, kind) for y in _types(b, kind)], axis=2)


def _table(panel: Panel, kind: str, population=None):
    """The panel's rows, and what makes alleles or dosages of them in a task."""
    if kind == "geno":
        return dosage_rows(panel, population)[:2]
    return panel.variants.select("chrom", "pos", "alleles") if panel.source is None else panel.rows, panel.matrix()


def banded(variants: DataFrame, matrix, max_dist: float, f, schema: str, coordinate: str = "pos") -> DataFrame:
    """Run ``f(left rows, right rows, left index, right index)`` over all pairs up to ``max_dist`` apart, tile by tile.

    ``f`` gets Arrow tables of the bucket in order and arrays of the pairs, and returns a table or None.
    """
    width = max(float(max_dist), 1e-12)
    b = F.floor(F.col(coordinate) / F.lit(width)).cast("long")
    sent = variants.withColumn("_b", F.explode(F.array(b, b - 1))).withColumn("_own", F.col("_b") == b)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(coordinate, "ascending"), ("pos", "ascending")])
        x, own = group[coordinate].to_numpy(), group["_own"].to_numpy(zero_copy_only=False)
        m = np.ascontiguousarray(matrix(group))
        out = []
        mine = np.flatnonzero(own)
        for lo in range(0, len(mine), TILE):
            i = mine[lo : lo + TILE]
            end = np.searchsorted(x, x[i[-1]] + max_dist, "right")
            for at in range(i[0], end, 4 * TILE):
                j = np.arange(at, min(end, at + 4 * TILE))
                near = (j[None, :] > i[:, None]) & (x[j][None, :] - x[i][:, None] <= max_dist)
                if near.any() and (t := f(group, m, i, j, near)) is not None:
                    out.append(t)
        return pa.concat_tables(out) if out else _empty(schema)

    return sent.groupBy("chrom", "_b").applyInArrow(run, schema)


_PA = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}


def _empty(schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([], _PA[t]) for n, t in fields})


def tiled(panel: Panel, kind: str, f, schema: str, population=None, tile: int = TILE) -> DataFrame:
    """Run ``f(rows of a, rows of b, same)`` over all pairs of tiles of the variants, in order of index."""
    matrix = _table(panel, kind, population)[1]
    v = panel.with_index().rows.withColumn("_t", (F.col("variant_idx") / tile).cast("long"))
    n = v.agg(F.max("_t")).first()[0]
    if n is None:
        return panel.spark.createDataFrame([], schema)
    left = v.withColumn("_o", F.explode(F.sequence("_t", F.lit(n)))).select("*", F.col("_t").alias("_a"), F.col("_o").alias("_z"))
    right = v.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t")))).select("*", F.col("_o").alias("_a"), F.col("_t").alias("_z")).where("_a < _z")
    both = left.unionByName(right).drop("_o")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("variant_idx")
        t = group["_t"].to_numpy()
        a, z = group["_a"][0].as_py(), group["_z"][0].as_py()
        m = np.ascontiguousarray(matrix(group))
        i, j = np.flatnonzero(t == a), np.flatnonzero(t == z)
        out = f(group, m, i, j, j[None, :] > i[:, None])
        return out if out is not None else _empty(schema)

    return both.groupBy("_a", "_z").applyInArrow(run, schema)


def _pops(panel: Panel, populations) -> list[list[int]]:
    return [list(panel.columns(p)) for p in (populations or (None,))]


def _count_columns(k: int, kind: str) -> list[str]:
    names = ["n11", "n10", "n01", "n00"] if kind == "hap" else ["n22", "n21", "n20", "n12", "n11", "n10", "n02", "n01", "n00"]
    return names if k == 0 else [f"{n}_{k}" for n in names]


def pairs(panel: Panel, max_dist: float | None = None, populations=None, kind: str = "hap") -> DataFrame:
    """``chrom, pos_i, pos_j`` and counts of types over samples called at both sites, per population.

    Counts of further populations have the suffix ``_1``, ``_2`` and so on. Without a
    distance all pairs of the panel are counted, within and between chromosomes.
    """
    cols = _pops(panel, populations) if kind == "hap" else _individuals(panel, populations)
    names = [n for k in range(len(cols)) for n in _count_columns(k, kind)]
    schema = "chrom string, pos_i long, pos_j long, " + ", ".join(f"{n} long" for n in names)

    def f(group, m, i, j, near):
        counts = [pair_counts(m[i][:, c], m[j][:, c], kind)[near] for c in cols]
        a, b = np.nonzero(near)
        pos = group["pos"].to_numpy()
        out = {"chrom": group["chrom"].take(pa.array(i[a])), "pos_i": pos[i[a]], "pos_j": pos[j[b]]}
        return pa.table(out | {n: np.rint(c).astype(np.int64) for n, c in zip(names, np.concatenate(counts, axis=1).T)})

    if max_dist is None:
        return tiled(panel, kind, f, schema)
    return banded(*_table(panel, kind), max_dist, f, schema)


def _individuals(panel: Panel, populations) -> list[list[int]]:
    """Columns of the dosage array, by population."""
    from .panel import diploid_columns

    first, _ = diploid_columns(panel.individual, range(panel.num_haplotypes))
    at = {panel.individual[c]: k for k, c in enumerate(first)}
    return [sorted({at[panel.individual[c]] for c in cols if panel.individual[c] in at}) for cols in _pops(panel, populations)]


def iter_pairs_within_distance(panel: Panel, max_dist: float) -> DataFrame:
    """``chrom, pos_i, pos_j`` of all pairs up to ``max_dist`` apart."""
    return pairs(panel, max_dist).select("chrom", "pos_i", "pos_j")


# -- per pair -----------------------------------------------------------------------


def r_column(suffix: str = "") -> Column:
    """Signed correlation of a row of haplotype counts; null where a site is monomorphic."""
    a, b, c, d = (F.col(x + suffix).cast("double") for x in ("n11", "n10", "n01", "n00"))
    den = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(den > 0, F.try_divide(a * d - b * c, F.sqrt(den)))


def r2_column(suffix: str = "") -> Column:
    r = r_column(suffix)
    return r * r


def d_prime_column(suffix: str = "") -> Column:
    a, b, c, d = (F.col(x + suffix).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n = a + b + c + d
    x = a * d - b * c
    top = F.when(x >= 0, F.least((a + b) * (b + d), (c + d) * (a + c))).otherwise(F.least((a + b) * (a + c), (c + d) * (b + d)))
    return F.when((n > 0) & (top > 0), F.try_divide(x, top))


def dd_column(suffix: str = "") -> Column:
    """Unbiased squared disequilibrium of a row of haplotype counts; 0 below four samples."""
    a, b, c, d = (F.col(x + suffix).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n = a + b + c + d
    num = a * (a - 1) * d * (d - 1) + b * (b - 1) * c * (c - 1) - 2 * a * b * c * d
    return F.when(n >= 4, F.try_divide(num, n * (n - 1) * (n - 2) * (n - 3))).otherwise(0.0)


def segregating(panel: Panel, population=None) -> Panel:
    def keep(m):
        n, d = (m >= 0).sum(axis=1), (m > 0).sum(axis=1)
        return (d > 0) & (d < n)

    return panel.where_counts(keep, population)


def pairwise_r2(panel: Panel, estimator: str = "r2") -> DataFrame:
    """``chrom, pos_i, pos_j, r2`` of all pairs, from site frequencies over each site's own calls."""
    if estimator == "rogers_huff":
        return rogers_huff_r(panel).select("chrom", "pos_i", "pos_j", (F.col("r") * F.col("r")).alias("r2"))

    def f(group, m, i, j, near):
        v, a = m >= 0, m > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            p = a.sum(axis=1) / v.sum(axis=1)
            both = v[i].astype(np.float64) @ v[j].T.astype(np.float64)
            ab = (a[i].astype(np.float64) @ a[j].T.astype(np.float64)) / both
            d = ab - np.outer(p[i], p[j])
            r2 = d * d / np.outer(p[i] * (1 - p[i]), p[j] * (1 - p[j]))
        x, y = np.nonzero(near)
        pos = group["pos"].to_numpy()
        value = r2[near]
        return pa.table({"chrom": group["chrom"].take(pa.array(i[x])), "pos_i": pos[i[x]], "pos_j": pos[j[y]], "r2": np.where(np.isfinite(value), value, np.nan)})

    return tiled(panel, "hap", f, "chrom string, pos_i long, pos_j long, r2 double")


def pairwise_ld(panel: Panel) -> DataFrame:
    """``chrom, pos_i, pos_j, d``: the disequilibrium coefficient of all pairs."""
    p = pairs(panel)
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    n = a + b + c + d
    return p.select("chrom", "pos_i", "pos_j", F.when(n > 0, F.try_divide(a * d - b * c, n * n)).otherwise(F.lit(NAN)).alias("d"))


def rogers_huff_r(panel: Panel, max_dist: float | None = None) -> DataFrame:
    """``chrom, pos_i, pos_j, r``: correlation of dosages; NaN for a constant site, an error for missing calls."""

    def f(group, m, i, j, near):
        if (m < 0).any():
            raise ValueError("the estimator needs complete dosages")
        z = m.astype(np.float64)
        z -= z.mean(axis=1, keepdims=True)
        s = np.sqrt((z * z).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (z[i] @ z[j].T) / np.outer(s[i], s[j])
        x, y = np.nonzero(near)
        pos = group["pos"].to_numpy()
        return pa.table({"chrom": group["chrom"].take(pa.array(i[x])), "pos_i": pos[i[x]], "pos_j": pos[j[y]], "r": r[near]})

    schema = "chrom string, pos_i long, pos_j long, r double"
    return tiled(panel, "geno", f, schema) if max_dist is None else banded(*_table(panel, "geno"), max_dist, f, schema)


def rogers_huff_r_squared(panel: Panel, max_dist: float | None = None) -> DataFrame:
    return rogers_huff_r(panel, max_dist).select("chrom", "pos_i", "pos_j", (F.col("r") * F.col("r")).alias("r2"))


def sigma_d2_geno(panel: Panel, max_dist: float | None = None) -> DataFrame:
    """``chrom, pos_i, pos_j, sigma_d2`` from dosages: DD over pi2; NaN where pi2 is 0."""

    def f(group, m, i, j, near):
        if (m < 0).any():
            raise ValueError("the estimator needs complete dosages")
        value = twolocus.sigma_d2(pair_counts(m[i], m[j], "geno")[near], "geno")
        x, y = np.nonzero(near)
        pos = group["pos"].to_numpy()
        return pa.table({"chrom": group["chrom"].take(pa.array(i[x])), "pos_i": pos[i[x]], "pos_j": pos[j[y]], "sigma_d2": value})

    schema = "chrom string, pos_i long, pos_j long, sigma_d2 double"
    return tiled(panel, "geno", f, schema) if max_dist is None else banded(*_table(panel, "geno"), max_dist, f, schema)


# -- summaries over pairs -------------------------------------------------------------


def zns(panel: Panel, missing_data: str = "include", estimator: str = "auto", kind: str = "hap") -> float:
    """Mean linkage over all pairs of segregating sites.

    ``sigma_d2`` (the choice for haplotypes) averages DD over pi2 of pairs with four
    or more samples, those with pi2 = 0 as 0; ``r2`` averages squared correlations;
    ``rogers_huff`` (the choice for dosages) squared correlations of dosages.
    """
    estimator = {"hap": "sigma_d2", "geno": "rogers_huff"}[kind] if estimator == "auto" else estimator
    if missing_data == "exclude":
        panel = panel.complete_only(None)
    panel = segregating(panel)

    def f(group, m, i, j, near):
        if estimator == "rogers_huff":
            value = _dosage_r2(m, i, j)[near]
            ok = np.ones(len(value), bool)
        else:
            c = pair_counts(m[i], m[j])[near]
            n = c.sum(axis=1)
            value, ok = (twolocus.sigma_d2(c), n >= 4) if estimator == "sigma_d2" else (twolocus.r_squared(c), n > 0)
        return pa.table({"total": [float(np.nan_to_num(value)[ok].sum())], "n": [int(ok.sum())]})

    total, n = tiled(panel, "geno" if estimator == "rogers_huff" else "hap", f, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
    return total / n if n else 0.0


def _dosage_r2(m: np.ndarray, i, j) -> np.ndarray:
    """Squared correlation over individuals called at both; 0 for constant sites."""
    v = (m >= 0).astype(np.float64)
    g = np.where(m >= 0, m, 0).astype(np.float64)
    n, sx, sy = v[i] @ v[j].T, g[i] @ v[j].T, v[i] @ g[j].T
    sxx, syy, sxy = (g * g)[i] @ v[j].T, v[i] @ (g * g)[j].T, g[i] @ g[j].T
    num, den = n * sxy - sx * sy, (n * sxx - sx**2) * (n * syy - sy**2)
    return np.divide(num**2, den, out=np.zeros_like(num), where=den > 1e-9)


def ld_matrix(panel: Panel, missing_data: str = "include", estimator: str = "sigma_d2") -> np.ndarray:
    """The symmetric matrix of one window's segregating sites, zero diagonal. For windows, on one machine."""
    if missing_data == "exclude":
        panel = panel.complete_only(None)
    h, _, _ = segregating(panel).to_numpy()
    return ld_block(h.T, estimator)


def ld_block(m: np.ndarray, estimator: str = "sigma_d2") -> np.ndarray:
    k = len(m)
    if not k:
        return np.zeros((0, 0))
    c = pair_counts(m, m).reshape(k * k, 4)
    value = np.nan_to_num(twolocus.sigma_d2(c) if estimator == "sigma_d2" else twolocus.r_squared(c)).reshape(k, k)
    np.fill_diagonal(value, 0)
    return value


def omega_of(r2: np.ndarray) -> float:
    """Kim and Nielsen's omega: the best split's linkage within over that between; 0 below five sites."""
    m = len(r2)
    if m < 5:
        return 0.0
    upper = np.triu(r2, 1)
    total = upper.sum()
    ends = np.cumsum(np.cumsum(upper, axis=0), axis=1)
    best = 0.0
    for k in range(3, m - 1):
        left = ends[k - 1, k - 1]
        cross = ends[k - 1, m - 1] - left
        right = total - left - cross
        if cross > 0:
            within = (left + right) / (k * (k - 1) / 2 + (m - k) * (m - k - 1) / 2)
            best = max(best, within / (cross / (k * (m - k))))
    return float(best)


def omega(panel: Panel, missing_data: str = "include", estimator: str = "auto", kind: str = "hap") -> float:
    """Of haplotypes by ``sigma_d2`` or ``r2``; of dosages by their squared correlation."""
    if kind == "geno":
        if missing_data == "exclude":
            panel = panel.complete_only(None)
        t = dosages(segregating(panel)).orderBy("chrom", "pos").select("g").toArrow()
        m = allele_matrix(t["g"])
        every = np.arange(len(m))
        return omega_of(_dosage_r2(m, every, every)) if len(m) else 0.0
    return omega_of(ld_matrix(panel, missing_data, "sigma_d2" if estimator == "auto" else estimator))


def mu_ld_of(m: np.ndarray) -> float:
    """How exclusively the haplotype patterns of a window's halves go together (variants by haplotypes).

    The mean, over both halves, of the share of patterns seen with one pattern of the other half.
    """
    k = len(m) // 2
    if k < 1:
        return 0.0
    pairs_seen = np.unique(np.stack((cluster_labels(np.ascontiguousarray(m[:k].T)), cluster_labels(np.ascontiguousarray(m[k:].T)))), axis=1)
    shares = [(np.unique(side, return_counts=True)[1] == 1).mean() for side in pairs_seen]
    return float(np.mean(shares))


def mu_ld(panel: Panel, missing_data: str = "include") -> float:
    if missing_data == "exclude":
        panel = panel.complete_only(None)
    return mu_ld_of(panel.to_numpy()[0].T)


def binned_sums(panel: Panel, bins, populations=None, kind: str = "hap", coordinate: DataFrame | None = None) -> DataFrame:
    """``bin, statistic, total, pairs``: sums of every named statistic over the pairs of each distance bin ``[a, b)``.

    Each task adds up its own pairs; a few rows per bucket are shuffled. ``coordinate``
    gives ``chrom, pos, x`` where distance isn't physical.
    """
    edges = np.asarray(bins, float)
    cols = _pops(panel, populations) if kind == "hap" else _individuals(panel, populations)
    names = twolocus.ld_names(len(cols))
    variants, matrix = _table(panel, kind)
    x = "pos"
    if coordinate is not None:
        variants, x = variants.join(coordinate.select("chrom", "pos", "x"), ["chrom", "pos"]), "x"

    def f(group, m, i, j, near):
        at = group[x].to_numpy()
        dist = (at[j][None, :] - at[i][:, None])[near]
        where = np.searchsorted(edges, dist, "right") - 1
        ok = (where >= 0) & (where < len(edges) - 1)
        if not ok.any():
            return None
        counts = twolocus.Counts([pair_counts(m[i][:, c], m[j][:, c], kind)[near][ok] for c in cols])
        values = twolocus.all_statistics(counts, len(cols), kind)
        n = len(edges) - 1
        found = np.bincount(where[ok], minlength=n)
        sums = np.stack([np.bincount(where[ok], v, n) for v in values.T], axis=1)
        hit = np.flatnonzero(found)
        return pa.table({"bin": np.repeat(hit, len(names)), "statistic": names * len(hit), "total": sums[hit].ravel(), "pairs": np.repeat(found[hit], len(names))})

    found = banded(variants, matrix, float(edges[-1]), f, "bin long, statistic string, total double, pairs long", x)
    return found.groupBy("bin", "statistic").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def ld_by_distance(panel: Panel, bp_bins, populations=None, raw: bool = False, ac_filter: bool = True, kind: str = "hap") -> DataFrame:
    """``bin, bin_start, bin_end, statistic, value``: mean (or sum) of each statistic per distance bin."""
    edges = [float(x) for x in bp_bins]
    base = panel.biallelic() if ac_filter else panel
    s = binned_sums(base, edges, populations, kind)
    at = F.array(*[F.lit(e) for e in edges])
    value = F.col("total") if raw else F.col("total") / F.col("pairs")
    return s.select("bin", F.element_at(at, (F.col("bin") + 1).cast("int")).alias("bin_start"), F.element_at(at, (F.col("bin") + 2).cast("int")).alias("bin_end"), "statistic", value.alias("value"), "pairs")


def windowed_r_squared(panel: Panel, bp_bins, percentile=50, pop=None, estimator: str = "r2") -> DataFrame:
    """``bin, bin_start, bin_end, p..., pairs``: exact percentiles of r2 per distance bin ``[a, b)``."""
    edges = [float(x) for x in bp_bins]
    wanted = [percentile] if np.isscalar(percentile) else list(percentile)
    base = panel if pop is None else panel.population(pop)
    if estimator == "rogers_huff":
        p = rogers_huff_r_squared(base, edges[-1]).where(~F.isnan("r2"))
    else:
        p = pairs(base, edges[-1]).select("chrom", "pos_i", "pos_j", r2_column().alias("r2")).where("r2 IS NOT NULL")
    d = F.col("pos_j") - F.col("pos_i")
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        bin_ = F.when((d >= edges[k]) & (d < edges[k + 1]), k).otherwise(bin_)
    at = F.array(*[F.lit(e) for e in edges])
    named = [F.expr(f"percentile(r2, {q / 100})").alias(f"p{q:g}".replace(".", "_")) for q in wanted]
    out = p.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("bin").agg(*named, F.count("*").alias("pairs"))
    return out.select("bin", F.element_at(at, F.col("bin") + 1).alias("bin_start"), F.element_at(at, F.col("bin") + 2).alias("bin_end"), *[c for c in out.columns if c != "bin"])


def mean_r2(panel: Panel, max_dist: float) -> float:
    v = pairs(segregating(panel), max_dist).agg(F.avg(r2_column())).first()[0]
    return NAN if v is None else v


def locate_unlinked(panel: Panel, size: int = 100, step: int = 20, threshold: float = 0.1) -> np.ndarray:
    """Which variants survive pruning by windows, in order: within a window a variant drops later ones linked to it.

    One pass along the genome, which carries what earlier windows dropped.
    """
    h, _, _ = panel.to_numpy()
    m = h.T
    keep = np.ones(len(m), bool)
    for lo in range(0, len(m), step):
        at = np.arange(lo, min(lo + size, len(m)))
        at = at[keep[at]]
        if len(at) < 2:
            continue
        r2 = ld_block(m[at], "r2")
        live = np.ones(len(at), bool)
        for k in range(len(at)):
            if live[k]:
                live[k + 1 :] &= ~(r2[k, k + 1 :] > threshold)
        keep[at[~live]] = False
    return keep
