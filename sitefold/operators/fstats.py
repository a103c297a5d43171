"""Admixture F-statistics and their block-jackknife averages.

Per-site terms are expressions over allele counts; blocks of variants are groups
of consecutive indices, summed in Spark. Only block sums reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.popmath import NAN
from .divergence import variant_windows
from .panel import Panel
from .resampling import block_jackknife


def _freq(k: int) -> tuple[Column, Column, Column]:
    """Derived frequency, unbiased p(1 - p) and called haplotypes of population k."""
    n, d = F.col(f"n{k}").cast("double"), F.col(f"d{k}").cast("double")
    return F.try_divide(d, n), F.try_divide(d * (n - d), n * (n - 1)), n


def _nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def f2_term(a: int = 0, b: int = 1) -> Column:
    (pa, ha, na), (pb, hb, nb) = _freq(a), _freq(b)
    return (pa - pb) * (pa - pb) - F.try_divide(ha, na) - F.try_divide(hb, nb)


def f3_terms(c: int = 0, a: int = 1, b: int = 2) -> tuple[Column, Column]:
    """T and B of a site: the product of differences less the bias, and twice the heterozygosity of c."""
    (pc, hc, nc), (pa, _, _), (pb, _, _) = _freq(c), _freq(a), _freq(b)
    return (pc - pa) * (pc - pb) - F.try_divide(hc, nc), 2 * hc


def d_terms() -> tuple[Column, Column]:
    a, b, c, d = (_freq(k)[0] for k in range(4))
    return (a - b) * (c - d), (a + b - 2 * a * b) * (c + d - 2 * c * d)


def _sites(panel: Panel, pops, missing_data: str, indexed: bool = False) -> DataFrame:
    if missing_data == "exclude":
        panel = panel.complete_only(*pops)
    if indexed:
        return panel.with_index().site_counts(*pops, keep=("variant_idx",))
    return panel.site_counts(*pops)


def patterson_f2(panel, pop_a, pop_b, missing_data="include") -> DataFrame:
    """``chrom, pos, f2``."""
    return _sites(panel, (pop_a, pop_b), missing_data).select("chrom", "pos", _nan(f2_term()).alias("f2"))


def patterson_f3(panel, pop_c, pop_a, pop_b, missing_data="include") -> DataFrame:
    """``chrom, pos, t, b``."""
    t, b = f3_terms()
    return _sites(panel, (pop_c, pop_a, pop_b), missing_data).select("chrom", "pos", _nan(t).alias("t"), _nan(b).alias("b"))


def patterson_d(panel, pop_a, pop_b, pop_c, pop_d, missing_data="include") -> DataFrame:
    """``chrom, pos, num, den``."""
    n, d = d_terms()
    return _sites(panel, (pop_a, pop_b, pop_c, pop_d), missing_data).select("chrom", "pos", _nan(n).alias("num"), _nan(d).alias("den"))


def _moving(panel, pops, terms, size, start, stop, step, missing_data, ratio=True) -> DataFrame:
    w = variant_windows(_sites(panel, pops, missing_data, True), size, start, stop, step)
    x, y = terms
    # terms are null where a population has no calls; sums skip those
    value = F.try_divide(F.sum(x), F.sum(y)) if ratio else F.avg(x)
    return w.groupBy("window_id").agg(_nan(value).alias("value"))


def moving_patterson_f3(panel, pop_c, pop_a, pop_b, size, start=0, stop=None, step=None, normed=True, missing_data="include") -> DataFrame:
    """``window_id, value`` over windows of ``size`` variants."""
    return _moving(panel, (pop_c, pop_a, pop_b), f3_terms(), size, start, stop, step, missing_data, normed)


def moving_patterson_d(panel, pop_a, pop_b, pop_c, pop_d, size, start=0, stop=None, step=None, missing_data="include") -> DataFrame:
    return _moving(panel, (pop_a, pop_b, pop_c, pop_d), d_terms(), size, start, stop, step, missing_data)


def block_sums(panel, pops, terms, blen: int, missing_data="include"):
    """Sums of two terms, and counts of the first, per whole block of ``blen`` variants, and over everything."""
    sites = _sites(panel, pops, missing_data, True).select("variant_idx", terms[0].alias("x"), terms[1].alias("y"))
    rows = sites.groupBy((F.col("variant_idx") / blen).cast("long").alias("block")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("x").alias("n"), F.count("*").alias("sites")).orderBy("block").collect()
    whole = [r for r in rows if r.sites == blen]
    part = lambda rs: np.array([[r.x or 0.0, r.y or 0.0, r.n] for r in rs]).reshape(-1, 3)
    return part(whole), part(rows).sum(axis=0)


def _average(panel, pops, terms, blen, missing_data, ratio=True):
    blocks, total = block_sums(panel, pops, terms, blen, missing_data)
    k = 1 if ratio else 2
    with np.errstate(invalid="ignore", divide="ignore"):
        estimate, values = total[0] / total[k], blocks[:, 0] / blocks[:, k]
        _, se, jack = block_jackknife((blocks[:, 0], blocks[:, k]), lambda x, y: x.sum() / y.sum())
    return float(estimate), se, float(estimate / se) if se else NAN, values, jack


def average_patterson_f3(panel, pop_c, pop_a, pop_b, blen, normed=True, missing_data="include"):
    """Estimate, standard error, z, block values and leave-one-out values; the rest after the last block counts for the estimate alone."""
    return _average(panel, (pop_c, pop_a, pop_b), f3_terms(), blen, missing_data, normed)


def average_patterson_d(panel, pop_a, pop_b, pop_c, pop_d, blen, missing_data="include"):
    return _average(panel, (pop_a, pop_b, pop_c, pop_d), d_terms(), blen, missing_data)
