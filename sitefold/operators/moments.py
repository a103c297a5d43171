"""Two-locus sums of one to four populations, by physical or genetic distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.twolocus import het_names, ld_names
from .ld import binned_sums
from .panel import Panel


def map_coordinates(panel: Panel, knots: list[tuple[float, float]]) -> DataFrame:
    """``chrom, pos, x``: Morgans by linear interpolation between knots (position, centimorgans), flat beyond them."""
    at, cm = (np.array(x, float) for x in zip(*sorted(knots)))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), pa.array(np.interp(b.column("pos").to_numpy().astype(float), at, cm / 100))], ["chrom", "pos", "x"])

    return panel.positions.mapInArrow(run, "chrom string, pos long, x double")


def heterozygosity(panel: Panel, populations, kind: str = "hap") -> dict[str, float]:
    """H_i_j: expected differences between draws from populations i and j, summed over sites."""
    sc = panel.site_counts(*populations, diploid=kind == "geno")
    n = [(F.col(f"n{k}") if kind == "hap" else 2 * F.col(f"m{k}")).cast("double") for k in range(len(populations))]
    d = [(F.col(f"d{k}") if kind == "hap" else F.col(f"a{k}")).cast("double") for k in range(len(populations))]
    terms = []
    for name in het_names(len(populations)):
        i, j = map(int, name.split("_")[1:])
        x = F.try_divide(2 * d[i] * (n[i] - d[i]), n[i] * (n[i] - 1)) if i == j else F.try_divide(d[i] * (n[j] - d[j]) + (n[i] - d[i]) * d[j], n[i] * n[j])
        ok = n[i] > 1 if i == j else (n[i] > 0) & (n[j] > 0)
        terms.append(F.sum(F.when(ok, x)).alias(name))
    r = sc.agg(*terms).first()
    return {k: v or 0.0 for k, v in r.asDict().items()}


def compute_ld_statistics(panel: Panel, pops=None, r_bins=None, bp_bins=None, genetic_map=None, use_genotypes: bool = False, ac_filter: bool = True) -> dict:
    """``bins``, ``sums`` (an array per bin, then heterozygosities), ``stats`` (their names) and ``pops``.

    ``genetic_map`` holds knots (position, centimorgans), needed for ``r_bins``.
    """
    names = list(pops or panel.pops)
    if not 1 <= len(names) <= 4:
        raise ValueError("one to four populations")
    if (r_bins is None) == (bp_bins is None):
        raise ValueError("either r_bins or bp_bins")
    if r_bins is not None and genetic_map is None:
        raise ValueError("r_bins need a genetic map")
    kind = "geno" if use_genotypes else "hap"
    base = panel.biallelic() if ac_filter else panel
    edges = np.asarray(r_bins if r_bins is not None else bp_bins, float)
    coordinate = map_coordinates(base, genetic_map) if r_bins is not None else None
    found = binned_sums(base, edges, names, kind, coordinate).collect()  # statistics times bins
    stats = ld_names(len(names))
    at = {s: k for k, s in enumerate(stats)}
    sums = [np.zeros(len(stats)) for _ in range(len(edges) - 1)]
    for r in found:
        sums[r.bin][at[r.statistic]] = r.total
    het = heterozygosity(base, names, kind)
    return {"bins": list(zip(edges[:-1].tolist(), edges[1:].tolist())), "sums": [*sums, np.array(list(het.values()))], "stats": (stats, list(het)), "pops": names}
