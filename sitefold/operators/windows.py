"""Statistics by genomic window.

A variant's windows follow from its position by arithmetic, so membership is an
``explode``, not a join. Additive statistics of any number are one aggregate over
per-site counts, partial sums first; windows without variants come from the list of
windows by a left join. Statistics of whole windows (haplotypes, linkage, local
PCA) get each window's variants as a group, a matrix of a window's size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.popmath import NAN, harmonics, variance_coefficients
from .divergence import dxy_term, hudson_terms, wc_terms
from .haplotypes import cluster_frequencies, garud
from .ld import ld_block, mu_ld_of, omega_of
from .mask import covered
from .panel import Panel, allele_matrix

PREFIX = ("chrom", "start", "end", "center", "n_variants", "window_id")
SINGLE = ("pi", "theta_w", "tajimas_d", "segregating_sites", "theta_h", "theta_l", "fay_wu_h", "singletons", "normalized_fay_wu_h", "zeng_e", "zeng_dh", "max_daf", "mu_var", "mu_sfs", "snp_dist_mean", "snp_dist_var", "snp_dist_min", "snp_dist_max", "het_expected", "n_singletons")
TWO = ("fst", "fst_hudson", "fst_wc", "dxy", "da")
MATRIX = ("garud_h1", "garud_h12", "garud_h123", "garud_h2h1", "haplotype_count", "haplotype_diversity", "zns", "omega", "mu_ld", "dist_var", "dist_skew", "dist_kurt", "mean_nsl", "mean_r2", "ld_decay", "daf_hist")


@dataclass(frozen=True)
class WindowParams:
    """``bp`` windows by size and step, ``snp`` windows by number of variants, or ``regions`` (chrom, start, end)."""

    window_type: str = "bp"
    window_size: int = 50_000
    step_size: int | None = None
    regions: list[tuple] = field(default_factory=list)

    @property
    def step(self) -> int:
        return self.step_size or self.window_size


def _bounds(panel: Panel, chrom_start: int | None, chrom_end: int | None) -> list[tuple[str, int, int]]:
    """Name, first and last position of each chromosome with variants; one pass for all that ask."""
    if "_chromosomes" not in panel.__dict__:
        rows = panel.rows.groupBy("chrom").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
        object.__setattr__(panel, "_chromosomes", sorted((r.chrom, r.lo, r.hi) for r in rows))
    return [(c, lo if chrom_start is None else chrom_start, hi if chrom_end is None else chrom_end) for c, lo, hi in panel.__dict__["_chromosomes"]]


def window_list(panel: Panel, params: WindowParams, from_first_variant: bool = False) -> DataFrame:
    """``chrom, window_id, start, end`` over ``[start, end)``; ids count up along chromosomes in order of name."""
    if params.window_type == "regions":
        rows = [(str(r[0]), i, int(r[1]), int(r[2])) for i, r in enumerate(params.regions)]
        return panel.spark.createDataFrame(rows, "chrom string, window_id long, start long, end long")
    lo, hi = (None, None) if from_first_variant else (panel.chrom_start, panel.chrom_end)
    bounds = _bounds(panel, lo, hi)
    rows, at = [], 0
    for chrom, lo, hi in bounds:
        n = max(1, -(-(hi - lo) // params.step))
        rows.append((chrom, at, lo, n))
        at += n
    base = panel.spark.createDataFrame(rows, "chrom string, first long, lo long, n long")
    k = base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("lo") + F.col("k") * params.step
    return k.select("chrom", (F.col("first") + F.col("k")).alias("window_id"), start.alias("start"), (start + params.window_size).alias("end"))


def _members(df: DataFrame, panel: Panel, params: WindowParams, from_first_variant: bool = False) -> DataFrame:
    """``df`` (with ``chrom, pos``) by ``window_id``; a variant in overlapping windows has several rows."""
    if params.window_type == "regions":
        w = F.broadcast(window_list(panel, params).withColumnRenamed("chrom", "_c"))  # as given by the caller
        return df.join(w, (df.chrom == w._c) & (df.pos >= w.start) & (df.pos < w.end)).drop("_c", "start", "end")
    lo, hi = (None, None) if from_first_variant else (panel.chrom_start, panel.chrom_end)
    bounds = _bounds(panel, lo, hi)
    if not bounds:
        return df.withColumn("window_id", F.lit(0).cast("long")).where("false")
    low, first, count, at = [], [], [], 0
    for _, a, b in bounds:
        low.append(a), first.append(at), count.append(max(1, -(-(b - a) // params.step)))
        at += count[-1]
    of = lambda v: F.element_at(F.create_map(*[x for (c, *_), y in zip(bounds, v) for x in (F.lit(c), F.lit(y).cast("long"))]), F.col("chrom"))
    off = F.col("pos") - of(low)
    high = F.least(F.floor(off / params.step).cast("long"), of(count) - 1)
    least = F.greatest(F.floor((off - params.window_size) / params.step).cast("long") + 1, F.lit(0).cast("long"))
    inside = df.where((off >= 0) & (least <= high))
    return inside.withColumn("window_id", F.explode(F.sequence(least + of(first), high + of(first))))


def _nan(c):
    return F.coalesce(c, F.lit(NAN))


def _harmonic_lookup(n: int):
    """1/a1(n) by n, as an array column of the cohort's size; one literal, for thousands of them are slow to plan."""
    values = ",".join(repr(float(1 / harmonics(k)[0])) if k >= 2 else "0.0" for k in range(n + 1))
    return F.split(F.lit(values), ",").cast("array<double>")


def windowed(panel: Panel, params: WindowParams, statistics=("pi",), populations=None, missing_data="include", span_normalize=True, keep_empty: bool = True, from_first_variant: bool = False, **kwargs) -> DataFrame:
    """The canonical frame: :data:`PREFIX`, then one column per statistic.

    With two populations, statistics of one are those of the first; with more, of each
    (``pi_NAME``), and those of two of each pair (``fst_A_B``). Callables get a window's
    alleles (variants by haplotypes) and positions, and are named by ``__name__``.
    """
    pops = list(populations) if populations else [None]
    named = [s for s in statistics if isinstance(s, str)]
    calls = [s for s in statistics if callable(s)]
    unknown = set(named) - set(SINGLE) - set(TWO) - set(MATRIX) - {"n_variants"}
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    if set(named) & set(TWO) and len(pops) < 2:
        raise ValueError("statistics of two populations need two")
    base = panel.complete_only(*pops) if missing_data == "exclude" else panel
    single, two = [s for s in named if s in SINGLE], [s for s in named if s in TWO]
    many = len(pops) > 2
    of_one = [(k, f"_{p}") for k, p in enumerate(pops)] if many else [(0, "")]
    of_two = [(a, b, f"_{pops[a]}_{pops[b]}" if many else "") for a in range(len(pops)) for b in range(a + 1, len(pops))]
    sc = base.site_counts(*pops, diploid="fst_wc" in two)
    snp = params.window_type == "snp"
    if snp:
        indexed = base.with_index()
        from .divergence import variant_windows

        sc = variant_windows(indexed.site_counts(*pops, diploid="fst_wc" in two, keep=("variant_idx",)), params.window_size, 0, None, params.step_size)
        m = sc
        w = m.groupBy("chrom", "window_id").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    else:
        m = _members(sc, base, params, from_first_variant)
        w = window_list(base, params, from_first_variant)
    aggs = [F.count("*").alias("n_variants")]
    for k, suffix in of_one:
        if single:
            aggs += _single_sums(k, len(base.columns(pops[k])), suffix)
    for a, b, suffix in of_two if two else ():
        aggs += _pair_sums(a, b, suffix, "fst_wc" in two)
    sums = m.groupBy("window_id").agg(*aggs)
    if {"snp_dist_mean", "snp_dist_var", "snp_dist_min", "snp_dist_max"} & set(single):
        sums = sums.join(_distances(m), "window_id", "left")
    out = w.join(sums, "window_id", "left" if keep_empty and not snp else "inner")
    zero = [F.coalesce(c, F.lit(0)).alias(c) if c.startswith(("s_", "n_variants")) else F.col(c) for c in sums.columns if c != "window_id"]
    out = out.select("chrom", "window_id", "start", "end", *zero)
    end = F.col("end") if panel.chrom_end is None or params.window_type != "bp" else F.least("end", F.lit(panel.chrom_end))
    if panel.chrom_end is None and params.window_type == "bp" and not from_first_variant:
        last = {c: hi for c, _, hi in _bounds(base, None, None)}
        if last:
            end = F.least("end", F.element_at(F.create_map(*[x for c, h in last.items() for x in (F.lit(c), F.lit(h).cast("long"))]), F.col("chrom")))
    out = out.withColumn("stop", F.col("end")).withColumn("end", end)
    if span_normalize is False:
        span = F.lit(1.0)
    elif panel.has_accessible_mask:
        out = out.join(covered(out.select("chrom", "window_id", "start", "end"), panel.mask), "window_id", "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
        span = F.when(F.col("bases") > 0, F.col("bases").cast("double"))
    elif panel.n_total_sites is not None and panel.chrom_start is not None and panel.chrom_end is not None:
        span = ((F.col("stop") - F.col("start")) * float(panel.n_total_sites) / float(panel.chrom_end - panel.chrom_start)).cast("double")
    else:
        span = F.when(F.col("end") > F.col("start"), (F.col("end") - F.col("start")).cast("double"))
    cols = []
    # null variances of a large cohort are dear, so only where asked for
    for k, suffix in of_one if single else ():
        made = _single_columns(single, suffix, len(base.columns(pops[k])), span)
        cols += [made[s].alias(s + suffix) for s in single]
    for _, _, suffix in of_two if two else ():
        made = _pair_columns(suffix, span)
        cols += [made[s].alias(s + suffix) for s in two]
    result = out.select("chrom", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("center"), F.col("n_variants").cast("long").alias("n_variants"), "window_id", *cols)
    whole = [s for s in named if s in MATRIX]
    if whole or calls:
        found = _matrix_statistics(base, params, whole, calls, pops[0], from_first_variant, **kwargs)
        result = result.join(found, "window_id", "left")
        for c in found.columns:
            if c != "window_id":
                result = result.withColumn(c, F.coalesce(c, F.lit(NAN)))
        result = result.select(*PREFIX, *[c for c in result.columns if c not in PREFIX])
    return result


def _single_sums(k: int, n_hap: int, suffix: str) -> list:
    n, d = F.col(f"n{k}").cast("double"), F.col(f"d{k}").cast("double")
    seg = (n >= 2) & (d > 0) & (d < n)
    pairs = n * (n - 1)
    when = lambda x: F.sum(F.when(seg, x).otherwise(0.0))
    return [
        when(F.try_divide(2 * d * (n - d), pairs)).alias(f"s_pi{suffix}"),
        when(F.element_at(_harmonic_lookup(n_hap), F.col(f"n{k}") + 1)).alias(f"s_w{suffix}"),
        when(F.try_divide(2 * d * d, pairs)).alias(f"s_h{suffix}"),
        when(F.try_divide(d, n - 1)).alias(f"s_l{suffix}"),
        F.count_if(seg).alias(f"s_seg{suffix}"),
        F.count_if(seg & ((d == 1) | (d == n - 1))).alias(f"s_one{suffix}"),
        F.max(F.when(seg, F.try_divide(d, n)).otherwise(0.0)).alias(f"s_daf{suffix}"),
        F.sum(F.when(n >= 2, 2 * F.try_divide(d, n) * (1 - F.try_divide(d, n)))).alias(f"s_he{suffix}"),
        F.count_if(n >= 2).alias(f"s_he_n{suffix}"),
    ]


def _single_columns(statistics, suffix: str, n_hap: int, span) -> dict:
    c = lambda x: F.col(f"s_{x}{suffix}")
    s = c("seg").cast("double")
    a1, a2 = harmonics(n_hap)
    rate = lambda x: _nan(x / span)

    def test(w1, w2, diff):
        if n_hap < 3:
            return F.lit(NAN)
        alpha, beta = variance_coefficients(w1, w2, n_hap)
        var = alpha * s / a1 + beta * s * (s - 1) / (a1 * a1 + a2)
        return F.when((var > 0) & (s >= 3), F.try_divide(diff, F.sqrt(var))).otherwise(F.lit(NAN))

    tajima, h = test("pi", "watterson", c("pi") - c("w")), (c("pi") - c("h")) / span
    return {
        "pi": rate(c("pi")),
        "theta_w": rate(c("w")),
        "theta_h": rate(c("h")),
        "theta_l": rate(c("l")),
        "fay_wu_h": _nan(h),
        "tajimas_d": tajima,
        "normalized_fay_wu_h": test("pi", "theta_h", c("pi") - c("h")),
        "zeng_e": test("theta_l", "watterson", c("l") - c("w")),
        "zeng_dh": F.when(span.isNull(), F.lit(NAN)).when((tajima < 0) & (h < 0), tajima * h).otherwise(0.0),
        "segregating_sites": c("seg").cast("long"),
        "singletons": c("one").cast("long"),
        "n_singletons": c("one").cast("long"),
        "max_daf": c("daf"),
        "het_expected": _nan(F.try_divide(c("he"), c("he_n"))),
        "mu_var": _nan(F.col("n_variants") / span),
        "mu_sfs": F.when(c("seg") > 0, F.try_divide(c("one"), c("seg"))).otherwise(0.0),
        "snp_dist_mean": _nan(F.col("snp_dist_mean")) if "snp_dist_mean" in statistics else F.lit(NAN),
        "snp_dist_var": _nan(F.col("snp_dist_var")) if "snp_dist_var" in statistics else F.lit(NAN),
        "snp_dist_min": _nan(F.col("snp_dist_min")) if "snp_dist_min" in statistics else F.lit(NAN),
        "snp_dist_max": _nan(F.col("snp_dist_max")) if "snp_dist_max" in statistics else F.lit(NAN),
    }


def _distances(members: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("window_id").orderBy("pos"))
    d = members.select("window_id", gap.cast("double").alias("gap"))
    return d.groupBy("window_id").agg(F.avg("gap").alias("snp_dist_mean"), F.var_pop("gap").alias("snp_dist_var"), F.min("gap").alias("snp_dist_min"), F.max("gap").alias("snp_dist_max"))


def _pair_sums(a: int, b: int, suffix: str, wc: bool) -> list:
    """Between and within differences per site, for the windowed ratio of sums."""
    n1, d1, n2, d2 = (F.col(x).cast("double") for x in (f"n{a}", f"d{a}", f"n{b}", f"d{b}"))
    within = lambda n, d: F.when(n > 1, F.try_divide(2 * d * (n - d), n * (n - 1))).otherwise(0.0)
    ok = (n1 > 0) & (n2 > 0)
    between = F.when(ok, F.try_divide(d1 * (n2 - d2) + (n1 - d1) * d2, n1 * n2)).otherwise(0.0)
    w1, w2 = within(n1, d1), within(n2, d2)
    out = [F.sum(between).alias(f"s_b{suffix}"), F.sum(F.when(ok, between - (w1 + w2) / 2).otherwise(0.0)).alias(f"s_f{suffix}"), F.sum(w1).alias(f"s_w1{suffix}"), F.sum(w2).alias(f"s_w2{suffix}")]
    if wc:
        x, y = wc_terms(a, b)
        out += [F.sum(x).alias(f"s_wcx{suffix}"), F.sum(y).alias(f"s_wcy{suffix}")]
    return out


def _pair_columns(suffix: str, span) -> dict:
    c = lambda x: F.col(f"s_{x}{suffix}")
    hudson = F.when(c("b") > 0, F.try_divide(c("f"), c("b"))).otherwise(F.lit(NAN))
    return {
        "fst": hudson,
        "fst_hudson": hudson,
        "fst_wc": F.when(c("wcy") != 0, F.try_divide(c("wcx"), c("wcy"))).otherwise(F.lit(NAN)),
        "dxy": _nan(c("b") / span),
        "da": _nan((c("b") - (c("w1") + c("w2")) / 2) / span),
    }


def window_groups(panel: Panel, params: WindowParams, f, schema: str, from_first_variant: bool = False) -> DataFrame:
    """``f(window_id, alleles: variants by haplotypes, positions)`` for each window with variants; a dict of lists each."""
    if params.window_type == "snp":
        from .divergence import variant_windows

        m = variant_windows(panel.indexed(), params.window_size, 0, None, params.step_size)
    else:
        m = _members(panel.variants.select("chrom", "pos", "alleles"), panel, params, from_first_variant)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("chrom", "ascending"), ("pos", "ascending")])
        found = f(group["window_id"][0].as_py(), allele_matrix(group["alleles"]), group["pos"].to_numpy())
        return pa.table({n: found[n] for n in names})

    return m.select("chrom", "pos", "alleles", "window_id").groupBy("window_id").applyInArrow(run, schema)


def _matrix_statistics(panel: Panel, params: WindowParams, names, calls, pop, from_first_variant, max_dist: float | None = None, ld_max_distance: float = 10_000, n_bins: int = 20, **kwargs) -> DataFrame:
    cols = list(panel.columns(pop))
    limit = max_dist if max_dist is not None else ld_max_distance
    out = [n for n in names if n != "daf_hist"] + ([f"daf_bin_{i}" for i in range(n_bins)] if "daf_hist" in names else []) + [c.__name__ for c in calls]

    def one(window_id, m, pos):
        from . import distance, scans

        m = m[:, cols]
        n, d = (m >= 0).sum(axis=1), (m > 0).sum(axis=1)
        seg = (d > 0) & (d < n)
        found: dict = {"window_id": window_id}
        if set(names) & {"garud_h1", "garud_h12", "garud_h123", "garud_h2h1", "haplotype_count", "haplotype_diversity"}:
            f = cluster_frequencies(np.ascontiguousarray(m.T))
            h = garud(f)
            found |= dict(zip(("garud_h1", "garud_h12", "garud_h123", "garud_h2h1"), h)) | {"haplotype_count": float(len(f)), "haplotype_diversity": (1 - h[0]) * len(cols) / (len(cols) - 1) if len(cols) > 1 else 0.0}
        if set(names) & {"zns", "omega"}:
            r2 = ld_block(m[seg])
            k = len(r2)
            found |= {"zns": float(r2.sum() / (k * (k - 1))) if k > 1 else 0.0, "omega": omega_of(r2)}
        if set(names) & {"mean_r2", "ld_decay"}:  # two names of one statistic
            r2, at = ld_block(m[seg], "r2"), pos[seg]
            near = np.triu(np.abs(at[:, None] - at[None, :]) <= limit, 1)
            mean = float(r2[near].mean()) if near.any() else NAN
            found |= {k: mean for k in ("mean_r2", "ld_decay") if k in names}
        if "mu_ld" in names:
            found["mu_ld"] = mu_ld_of(m)
        if set(names) & {"dist_var", "dist_skew", "dist_kurt"}:
            found |= dict(zip(("dist_var", "dist_skew", "dist_kurt"), distance.moments(distance.haploid_differences(m))))
        if "mean_nsl" in names:
            s = scans.nsl_matrix(m)
            found["mean_nsl"] = float(np.nanmean(s)) if np.isfinite(s).any() else NAN
        if "daf_hist" in names:
            share = np.histogram(np.divide(d, n, out=np.zeros(len(n)), where=n > 0), np.linspace(0, 1, n_bins + 1))[0] / max(1, len(n))
            found |= {f"daf_bin_{i}": float(x) for i, x in enumerate(share)}
        found |= {c.__name__: float(c(m, pos, **kwargs)) for c in calls}
        return {k: [v] for k, v in found.items()}

    return window_groups(panel, params, one, "window_id long, " + ", ".join(f"{n} double" for n in out), from_first_variant)


def windowed_analysis(panel: Panel, window_size=50_000, step_size=None, statistics=("pi",), populations=None, missing_data="include", span_normalize=True, accessible_bed: DataFrame | None = None, chrom=None, **kwargs) -> DataFrame:
    """Windows of ``window_size`` bases every ``step_size`` from the chromosome's start; see :func:`windowed`.

    ``local_pca`` and ``local_pca_jackknife`` give array columns, joined to the others.
    """
    if accessible_bed is not None:
        panel = panel.set_accessible_mask(accessible_bed, chrom)
    params = WindowParams("bp", window_size, step_size)
    local = [s for s in statistics if s in ("local_pca", "local_pca_jackknife")]
    rest = [s for s in statistics if s not in local]
    pca_args = {k: kwargs.pop(k) for k in ("k", "scaler", "n_blocks") if k in kwargs}
    out = windowed(panel, params, rest or ["n_variants"], populations, missing_data, span_normalize, **kwargs)
    for s in local:
        from .decomposition import local_pca, local_pca_jackknife

        args = {x: v for x, v in pca_args.items() if x != "n_blocks" or s == "local_pca_jackknife"}
        found = (local_pca if s == "local_pca" else local_pca_jackknife)(panel, params, missing_data=missing_data, **args)
        out = out.join(found.select("window_id", *[c for c in found.columns if c not in out.columns]), "window_id", "left")
    return out


def windowed_statistics(panel: Panel, bp_bins, statistics=("pi", "theta_w", "tajimas_d"), population=None, pop1=None, pop2=None, per_base=True, **kwargs) -> DataFrame:
    """Statistics between custom edges; the last bin ends before its edge."""
    edges = [int(x) for x in bp_bins]
    chroms = [r.chrom for r in panel.rows.select("chrom").distinct().collect()]
    regions = [(c, a, b) for c in sorted(chroms) for a, b in zip(edges, edges[1:])]
    pops = [pop1, pop2] if pop1 is not None else [population] if population is not None else None
    return windowed(panel, WindowParams("regions", regions=regions), statistics, pops, span_normalize=per_base, **kwargs)


windowed_statistics_fused = windowed_statistics_fused_chunked = windowed_statistics


class WindowedAnalyzer:
    """Windows from the first variant on, without empty ones; ``bp``, ``snp`` or ``regions``."""

    def __init__(self, window_type="bp", window_size=50_000, step_size=None, regions=None, statistics=("pi",), populations=None, missing_data="include", span_normalize=True, ld_max_distance=10_000, **ignored):
        self.params = WindowParams(window_type, window_size, step_size, list(regions or ()))
        self.statistics, self.populations, self.missing_data, self.span_normalize, self.ld_max_distance = list(statistics), populations, missing_data, span_normalize, ld_max_distance

    def compute(self, panel: Panel) -> DataFrame:
        return windowed(panel, self.params, self.statistics, self.populations, self.missing_data, self.span_normalize, keep_empty=False, from_first_variant=True, ld_max_distance=self.ld_max_distance)

    def compute_region(self, panel: Panel, chrom, start, end) -> DataFrame:
        return self.compute(panel.between(start, end, chrom))

    def compute_streaming(self, panel: Panel, batch_size: int = 100):
        """Frames of ``batch_size`` windows, one after the other; partitions come to the driver in turn."""
        import pandas as pd

        rows, df = [], self.compute(panel).orderBy("window_id")
        for r in df.toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == batch_size:
                yield pd.DataFrame(rows, columns=df.columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=df.columns)


def count_windows(panel: Panel, params: WindowParams) -> int:
    return window_list(panel, params).count()
