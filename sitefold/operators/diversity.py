"""Diversity and neutrality statistics of one population.

Everything additive over sites follows from how many sites have d derived among n
called haplotypes. That table, at most (haplotypes + 1)^2 / 2 rows however long the
genome, is one aggregate over the panel; estimators are dot products with it.

``missing_data``: ``include`` uses the called haplotypes of each site, ``exclude``
drops sites with a missing call in the population. Undefined results are NaN.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.popmath import NAN, WEIGHTS, harmonics, neutrality_score, project_sfs, weight_vector
from .haplotypes import haplotype_frequencies
from .panel import Panel


def _prepared(panel: Panel, population, missing_data: str) -> Panel:
    if missing_data not in ("include", "exclude"):
        raise ValueError("missing_data is include or exclude")
    return panel.complete_only(population) if missing_data == "exclude" else panel


def count_table(panel: Panel, population=None, missing_data: str = "include") -> DataFrame:
    """``n, d, sites``: sites by called haplotypes and derived alleles."""
    sc = _prepared(panel, population, missing_data).site_counts(population)
    return sc.groupBy(F.col("n0").alias("n"), F.col("d0").alias("d")).agg(F.count("*").alias("sites"))


def frequency_spectra(panel: Panel, populations, missing_data: str = "include") -> dict[str, FrequencySpectrum]:
    """The spectra of several populations from one pass (with ``exclude``, one each)."""
    names = list(populations)
    if missing_data != "include":
        return {p: FrequencySpectrum(panel, p, missing_data, n_total_sites=0) for p in names}
    sc = panel.site_counts(*names)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n"), F.col(f"d{k}").alias("d")) for k in range(len(names))])).alias("x")
    # a large cohort has many cells, so they come as columns
    k, n, d, sites = _columns(sc.select(each).groupBy("x.k", "x.n", "x.d").agg(F.count("*").alias("sites")), "k", "n", "d", "sites")
    return {p: FrequencySpectrum(table=zip(n[k == i], d[k == i], sites[k == i])) for i, p in enumerate(names)}


def _columns(df: DataFrame, *names) -> list[np.ndarray]:
    t = df.toArrow()
    return [t[c].to_numpy() for c in names]


class FrequencySpectrum:
    """Sites grouped by sample size; spectra, estimators and tests follow from it."""

    def __init__(self, panel: Panel | None = None, population=None, missing_data: str = "include", *, table=None, n_total_sites: int | None = None):
        if table is None:
            table = zip(*_columns(count_table(panel, population, missing_data), "n", "d", "sites"))
            n_total_sites = n_total_sites if n_total_sites is not None else panel.n_total_sites
        self.sfs_by_n: dict[int, np.ndarray] = {}
        for n, d, sites in table:
            self.sfs_by_n.setdefault(int(n), np.zeros(int(n) + 1))[int(d)] += sites
        self.n_sites = int(sum(v.sum() for v in self.sfs_by_n.values()))
        self.n_max = max(self.sfs_by_n, default=0)
        if n_total_sites is not None and n_total_sites > self.n_sites and self.n_max:
            self.sfs_by_n[self.n_max][0] += n_total_sites - self.n_sites

    def segregating(self) -> dict[int, np.ndarray]:
        """Spectra of sample sizes of two or more, fixed classes zeroed."""
        out = {}
        for n, s in self.sfs_by_n.items():
            if n >= 2:
                out[n] = s.copy()
                out[n][[0, n]] = 0
        return out

    def n_segregating(self) -> int:
        return int(sum(s.sum() for s in self.segregating().values()))

    def theta(self, weights="pi", span_normalize: bool = False, span: float | None = None) -> float:
        """An estimator by name, or by a callable from n to weights of k = 0..n."""
        total = float(sum(s @ weight_vector(weights, n) for n, s in (self.sfs_by_n if callable(weights) else self.segregating()).items() if n >= 2))
        if not span_normalize:
            return total
        if not span:
            raise ValueError("a span is needed")
        return total / span

    def harmonic_n(self) -> int:
        """Rounded harmonic mean of site sample sizes of two or more."""
        n = {k: s.sum() for k, s in self.sfs_by_n.items() if k >= 2 and s.sum()}
        return round(sum(n.values()) / sum(v / k for k, v in n.items())) if n else 0

    def neutrality_test(self, w1="pi", w2="watterson") -> float:
        """Standardised difference of two estimators at the most frequent sample size."""
        seg = {n: s.sum() for n, s in self.sfs_by_n.items() if n >= 2}
        if not seg:
            return NAN
        n = max(seg, key=lambda k: (seg[k], k))
        return neutrality_score(self.theta(w1) - self.theta(w2), w1, w2, n, self.n_segregating())

    def test(self, w1, w2) -> float:
        """The same at the harmonic mean of sample sizes, as the scalar functions have it."""
        return neutrality_score(self.theta(w1) - self.theta(w2), w1, w2, self.harmonic_n(), self.n_segregating())

    def suggest_projection_n(self, retain_fraction: float = 0.95) -> int:
        """The largest sample size that keeps this share of the segregating sites."""
        seg = {n: s.sum() for n, s in self.segregating().items()}
        total, kept = sum(seg.values()), 0.0
        for n in sorted(seg, reverse=True):
            kept += seg[n]
            if kept >= retain_fraction * total:
                return n
        return max(seg, default=0)

    def project(self, target_n: int) -> np.ndarray:
        """Spectrum at ``target_n``; sites of fewer haplotypes are left out."""
        parts = [project_sfs(s, n, target_n) for n, s in self.sfs_by_n.items() if n >= target_n]
        return np.sum(parts, axis=0) if parts else np.zeros(target_n + 1)

    def sfs(self, n: int | None = None) -> np.ndarray:
        return self.sfs_by_n.get(self.n_max, np.zeros(1)) if n is None else self.project(n)

    def all_thetas(self, span_normalize: bool = False, span: float | None = None) -> dict[str, float]:
        return {w: self.theta(w, span_normalize, span) for w in WEIGHTS}

    def tajimas_d(self) -> float:
        return self.neutrality_test("pi", "watterson")

    def fay_wu_h(self, normalized: bool = False) -> float:
        return self.neutrality_test("pi", "theta_h") if normalized else self.theta("pi") - self.theta("theta_h")

    def zeng_e(self) -> float:
        return self.neutrality_test("theta_l", "watterson")

    def all_tests(self) -> dict[str, float]:
        return {"tajimas_d": self.tajimas_d(), "fay_wu_h": self.fay_wu_h(), "normalized_fay_wu_h": self.fay_wu_h(True), "zeng_e": self.zeng_e()}


def _spectrum(panel, population, missing_data) -> FrequencySpectrum:
    return FrequencySpectrum(panel, population, missing_data, n_total_sites=0)


def per_span(panel: Panel, value: float, span_normalize) -> float:
    """A sum over sites as a rate: False, True (automatic span) or a span's name."""
    if span_normalize is False:
        return value
    span = panel.get_span("auto" if span_normalize is True else span_normalize)
    return value / span if span > 0 else NAN


def _theta(name):
    def f(panel: Panel, population=None, span_normalize=True, missing_data: str = "include") -> float:
        return per_span(panel, _spectrum(panel, population, missing_data).theta(name), span_normalize)

    return f


pi, theta_w, theta_h, theta_l = map(_theta, ("pi", "watterson", "theta_h", "theta_l"))


def tajimas_d(panel, population=None, missing_data="include") -> float:
    return _spectrum(panel, population, missing_data).test("pi", "watterson")


def fay_wus_h(panel, population=None, missing_data="include") -> float:
    s = _spectrum(panel, population, missing_data)
    return s.theta("pi") - s.theta("theta_h")


def normalized_fay_wus_h(panel, population=None, missing_data="include") -> float:
    return _spectrum(panel, population, missing_data).test("pi", "theta_h")


def zeng_e(panel, population=None, missing_data="include") -> float:
    return _spectrum(panel, population, missing_data).test("theta_l", "watterson")


def zeng_dh(panel, population=None, missing_data="include") -> float:
    s = _spectrum(panel, population, missing_data)
    d, h = s.test("pi", "watterson"), s.theta("pi") - s.theta("theta_h")
    return d * h if d < 0 and h < 0 else 0.0


def segregating_sites(panel, population=None, missing_data="include") -> int:
    return _spectrum(panel, population, missing_data).n_segregating()


def singleton_count(panel, population=None, missing_data="include") -> int:
    """Sites with one derived allele."""
    return int(sum(s[1] for n, s in _spectrum(panel, population, missing_data).sfs_by_n.items() if n >= 1))


def allele_frequency_spectrum(panel, population=None, missing_data="include") -> np.ndarray:
    """Sites by derived count, sample sizes mixed; length haplotypes + 1."""
    out = np.zeros(len(panel.columns(population)) + 1, np.int64)
    for n, s in _spectrum(panel, population, missing_data).sfs_by_n.items():
        if n > 0:
            out[: n + 1] += s.astype(np.int64)
    return out


_STATISTICS = {
    "pi": lambda s, span: s.theta("pi") / span,
    "theta_w": lambda s, span: s.theta("watterson") / span,
    "theta_h": lambda s, span: s.theta("theta_h") / span,
    "theta_l": lambda s, span: s.theta("theta_l") / span,
    "tajimas_d": lambda s, span: s.test("pi", "watterson"),
    "fay_wus_h": lambda s, span: s.theta("pi") - s.theta("theta_h") if s.n_segregating() >= 3 else NAN,
    "normalized_fay_wus_h": lambda s, span: s.test("pi", "theta_h"),
    "zeng_e": lambda s, span: s.test("theta_l", "watterson"),
    "segregating_sites": lambda s, span: s.n_segregating(),
    "singletons": lambda s, span: int(sum(x[1] for n, x in s.sfs_by_n.items() if n >= 1)),
    "n_variants": lambda s, span: s.n_sites,
}


def diversity_stats(panel, population=None, statistics=("pi", "theta_w", "tajimas_d"), span_normalize=True, missing_data="include", spectrum: FrequencySpectrum | None = None) -> dict:
    """Several statistics from one pass over the panel, or from a spectrum at hand."""
    unknown = set(statistics) - set(_STATISTICS) - {"haplotype_diversity"}
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    s = spectrum if spectrum is not None else _spectrum(panel, population, missing_data)
    span = 1.0 if span_normalize is False else panel.get_span("auto" if span_normalize is True else span_normalize)
    return {k: haplotype_diversity(panel, population, missing_data) if k == "haplotype_diversity" else _STATISTICS[k](s, span) for k in statistics}


def neutrality_tests(panel, population=None, missing_data="include") -> dict:
    s = _spectrum(panel, population, missing_data)
    return {"tajimas_d": s.test("pi", "watterson"), "fay_wus_h": s.theta("pi") - s.theta("theta_h"), "pi": s.theta("pi"), "theta_w": s.theta("watterson"), "segregating_sites": s.n_segregating()}


def haplotype_diversity(panel, population=None, missing_data="include") -> float:
    """(1 - sum of squared frequencies) n / (n - 1) of distinct haplotypes; 0 for one haplotype."""
    n = len(panel.columns(population))
    if n <= 1:
        return 0.0
    f = haplotype_frequencies(_prepared(panel, population, missing_data), population)
    return float((1 - (f**2).sum()) * n / (n - 1))


def haplotype_count(panel, population=None, missing_data="include") -> int:
    return len(haplotype_frequencies(_prepared(panel, population, missing_data), population))


def max_daf(panel, population=None, missing_data="include") -> float:
    return float(max((np.flatnonzero(s)[-1] / n for n, s in _spectrum(panel, population, missing_data).sfs_by_n.items() if n > 0 and s.any()), default=0.0))


def daf_histogram(panel, n_bins=20, population=None, missing_data="include"):
    """Shares of sites by derived frequency; the last bin is closed, sites without calls count as 0."""
    edges, hist = np.linspace(0, 1, n_bins + 1), np.zeros(n_bins)
    for n, s in _spectrum(panel, population, missing_data).sfs_by_n.items():
        f = np.arange(n + 1) / n if n else np.zeros(1)
        hist += np.histogram(f, edges, weights=s)[0]
    return (hist / hist.sum() if hist.sum() else hist), edges


def mu_var(panel, window_length=None, population=None) -> float:
    """Variants per base of the window."""
    length = window_length if window_length is not None else (panel.chrom_end - panel.chrom_start if panel.chrom_end is not None and panel.chrom_start is not None else panel.get_span() - 1)
    return panel.num_variants / length if length > 0 else 0.0


def mu_sfs(panel, population=None, missing_data="include") -> float:
    """Share of segregating sites that are singletons on either side."""
    seg = _spectrum(panel, population, missing_data).segregating()
    total = sum(s.sum() for s in seg.values())
    edge = sum(s[1] + (s[n - 1] if n > 2 else 0) for n, s in seg.items())
    return float(edge / total) if total else 0.0


def pi_components(panel, population=None, n_total_sites=None) -> dict:
    """Differences, comparisons, missing comparisons and sites behind pi."""
    full = len(panel.columns(population))
    s = _spectrum(panel, population, "include").sfs_by_n
    diffs = sum(float(x @ (np.arange(n + 1) * (n - np.arange(n + 1)))) for n, x in s.items())
    sites = int(sum(x.sum() for x in s.values()))
    comps = sum(float(x.sum()) * n * (n - 1) / 2 for n, x in s.items())
    padding = max(0, (n_total_sites or sites) - sites)
    comps += padding * full * (full - 1) / 2
    total = sites + padding
    return {"diffs": diffs, "comps": comps, "missing": total * full * (full - 1) / 2 - comps, "n_sites": total}


def heterozygosity_expected(panel, population=None, missing_data="include") -> DataFrame:
    """``chrom, pos, he``: 2p(1 - p) of each site, NaN below two calls."""
    sc = _prepared(panel, population, missing_data).site_counts(population)
    p = F.try_divide("d0", "n0")
    return sc.select("chrom", "pos", F.when(F.col("n0") >= 2, 2 * p * (1 - p)).otherwise(F.lit(NAN)).alias("he"))


def heterozygosity_observed(panel, population=None, missing_data="include") -> DataFrame:
    """``chrom, pos, ho``: share of heterozygotes among individuals with both calls."""
    sc = _prepared(panel, population, missing_data).site_counts(population, diploid=True)
    return sc.select("chrom", "pos", F.when(F.col("m0") > 0, F.try_divide("h0", "m0")).otherwise(F.lit(NAN)).alias("ho"))


def inbreeding_coefficient(panel, population=None, missing_data="include") -> DataFrame:
    """``chrom, pos, f``: 1 - observed over expected heterozygosity, NaN where nothing is expected."""
    sc = _prepared(panel, population, missing_data).site_counts(population, diploid=True)
    p = F.try_divide("d0", "n0")
    he, ho = F.when(F.col("n0") >= 2, 2 * p * (1 - p)), F.when(F.col("m0") > 0, F.try_divide("h0", "m0"))
    return sc.select("chrom", "pos", F.when(he > 0, F.coalesce(1 - F.try_divide(ho, he), F.lit(NAN))).otherwise(F.lit(NAN)).alias("f"))


def diplotype_frequency_spectrum(panel, population=None):
    """Frequencies of distinct multi-site dosages, largest first, and their number."""
    from .haplotypes import diplotype_frequencies

    f = diplotype_frequencies(panel, population)
    return f, len(f)
