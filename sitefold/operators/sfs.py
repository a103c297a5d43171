"""Site-frequency spectra, alone and joint, folded and scaled.

Spectra are aggregates in long form; dense arrays are made on the driver, whose
size is set by the cohort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import keep
from .diversity import _prepared
from .panel import Panel


def sfs_table(panel: Panel, population=None, missing_data="include", folded=False) -> DataFrame:
    """``k, sites`` by derived (or minor) count."""
    sc = _prepared(panel, population, missing_data).site_counts(population)
    k = F.least("d0", F.col("n0") - F.col("d0")) if folded else F.col("d0")
    return sc.groupBy(k.alias("k")).agg(F.count("*").alias("sites"))


def _n_max(panel, population, missing_data) -> int:
    n = _prepared(panel, population, missing_data).site_counts(population).agg(F.max("n0")).first()[0]
    return len(panel.columns(population)) if n is None else n


def _dense(rows, *shape) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    for r in rows:
        out[tuple(r[:-1])] = r[-1]
    return out


def sfs(panel, population=None, missing_data="include") -> np.ndarray:
    return _dense(sfs_table(panel, population, missing_data).collect(), _n_max(panel, population, missing_data) + 1)


def sfs_folded(panel, population=None, missing_data="include") -> np.ndarray:
    return _dense(sfs_table(panel, population, missing_data, True).collect(), _n_max(panel, population, missing_data) // 2 + 1)


def sfs_scaled(panel, population=None, missing_data="include") -> np.ndarray:
    return scale_sfs(sfs(panel, population, missing_data))


def sfs_folded_scaled(panel, population=None, missing_data="include") -> np.ndarray:
    return scale_sfs_folded(sfs_folded(panel, population, missing_data), _n_max(panel, population, missing_data))


def joint_sfs_table(panel: Panel, pop1, pop2, missing_data="include", folded=False) -> DataFrame:
    """``k1, k2, sites``: only the cells that occur."""
    if missing_data == "exclude":
        panel = panel.complete_only(pop1, pop2)
    sc = panel.site_counts(pop1, pop2)
    k = [F.least(f"d{i}", F.col(f"n{i}") - F.col(f"d{i}")) if folded else F.col(f"d{i}") for i in (0, 1)]
    return sc.groupBy(k[0].alias("k1"), k[1].alias("k2")).agg(F.count("*").alias("sites"))


def _joint(panel, pop1, pop2, missing_data, folded):
    if missing_data == "exclude":
        panel = panel.complete_only(pop1, pop2)
    n = panel.site_counts(pop1, pop2).agg(F.max("n0"), F.max("n1")).first()
    n = [x if x is not None else len(panel.columns(p)) for x, p in zip(n, (pop1, pop2))]
    shape = [x // 2 + 1 if folded else x + 1 for x in n]
    return _dense(joint_sfs_table(panel, pop1, pop2, "include", folded).collect(), *shape), n


def joint_sfs(panel, pop1, pop2, missing_data="include") -> np.ndarray:
    return _joint(panel, pop1, pop2, missing_data, False)[0]


def joint_sfs_folded(panel, pop1, pop2, missing_data="include") -> np.ndarray:
    return _joint(panel, pop1, pop2, missing_data, True)[0]


def joint_sfs_scaled(panel, pop1, pop2, missing_data="include") -> np.ndarray:
    return scale_joint_sfs(joint_sfs(panel, pop1, pop2, missing_data))


def joint_sfs_folded_scaled(panel, pop1, pop2, missing_data="include") -> np.ndarray:
    s, n = _joint(panel, pop1, pop2, missing_data, True)
    return scale_joint_sfs_folded(s, *n)


def joint_sfs_scaled_table(panel: Panel, pop1, pop2, missing_data="include") -> DataFrame:
    """``folded, k1, k2, value`` (long): the cells of both scaled joint spectra that aren't 0, from one pass.

    A dense spectrum grows with the product of both cohorts, this with the sites at most.
    """
    if missing_data == "exclude":
        panel = panel.complete_only(pop1, pop2)
    counts = keep(panel.site_counts(pop1, pop2).groupBy("n0", "d0", "n1", "d1").agg(F.count("*").alias("sites")))
    n1, n2 = (F.lit(x or 0).cast("long") for x in counts.agg(F.max("n0"), F.max("n1")).first())
    n0, d0, n1_, d1 = (F.col(c).cast("long") for c in ("n0", "d0", "n1", "d1"))
    plain = counts.select(F.lit(False).alias("folded"), d0.alias("k1"), d1.alias("k2"), "sites")
    minor = counts.select(F.lit(True).alias("folded"), F.least(d0, n0 - d0).alias("k1"), F.least(d1, n1_ - d1).alias("k2"), "sites")
    cells = plain.unionByName(minor).groupBy("folded", "k1", "k2").agg(F.sum("sites").alias("sites"))
    x, y = F.col("k1"), F.col("k2")
    value = F.col("sites") * x * y * F.when(F.col("folded"), (n1 - x) * (n2 - y)).otherwise(F.lit(1))
    return cells.select("folded", x, y, value.alias("value")).where("value <> 0")


def scale_sfs(s) -> np.ndarray:
    s = np.asarray(s)
    return s * np.arange(len(s))


def scale_sfs_folded(s, n: int) -> np.ndarray:
    s = np.asarray(s)
    k = np.arange(len(s))
    return s * k * (n - k) / n


def scale_joint_sfs(s) -> np.ndarray:
    s = np.asarray(s)
    i, j = np.indices(s.shape)
    return s * i * j


def scale_joint_sfs_folded(s, n1: int, n2: int) -> np.ndarray:
    s = np.asarray(s)
    i, j = np.indices(s.shape)
    return s * i * j * (n1 - i) * (n2 - j)


def fold_sfs(s, n: int) -> np.ndarray:
    """Fold by pairing the first (n + 1) // 2 classes with the next ones mirrored; an even n's last class goes."""
    s = np.asarray(s)
    half = (n + 1) // 2
    s = np.concatenate((s, np.zeros(max(0, 2 * half - len(s)), s.dtype)))[: 2 * half]
    return s[:half] + s[half:][::-1]


def fold_joint_sfs(s, n1: int, n2: int) -> np.ndarray:
    """The same in both dimensions."""
    once = np.apply_along_axis(fold_sfs, 0, np.asarray(s), n1)
    return np.apply_along_axis(fold_sfs, 1, once, n2)
