"""Identity of whole haplotypes.

The panel is transposed block-wise in tasks: each batch of variants gives one
chunk of alleles per haplotype, packed as bytes with the batch's first position.
Without missing calls a haplotype's key is the list of its chunks' hashes (two of
64 bits), so what moves is a few bytes per haplotype and batch; a diplotype's is two
sums of its dosages times 64-bit hashes of the sites, so a task adds up its own. With missing calls
a -1 agrees with anything; that relation is not transitive, and haplotypes are
clustered one after the other, each joining the first cluster it agrees with.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import Panel, allele_matrix, dosage_rows, dosages, pieces


def rows_of(variants: DataFrame, column: str = "alleles", cols=None) -> np.ndarray:
    """The matrix by row (haplotype or individual), variants in order of position."""
    t = variants.orderBy("chrom", "pos").select(column).toArrow()
    m = allele_matrix(t[column]).T
    return np.ascontiguousarray(m if cols is None else m[list(cols)])


def cluster_labels(rows: np.ndarray) -> np.ndarray:
    """A label per row; equal for rows that agree. -1 agrees with anything, and the first match wins."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if not (rows < 0).any():
        return np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    heads = np.empty_like(rows)
    labels, k = np.empty(len(rows), np.int64), 0
    for i, r in enumerate(rows):
        h = heads[:k]
        match = np.flatnonzero(((h == r) | (h < 0) | (r < 0)).all(axis=1))
        if len(match):
            labels[i] = match[0]
            heads[match[0]] = np.where(h[match[0]] >= 0, h[match[0]], r)
        else:
            heads[k], labels[i] = r, k
            k += 1
    return labels


def cluster_frequencies(rows: np.ndarray) -> np.ndarray:
    """Frequencies of distinct rows, largest first."""
    if not len(rows):
        return np.zeros(0)
    return np.sort(np.bincount(cluster_labels(rows)) / len(rows))[::-1]


def _has_missing(panel: Panel, population) -> bool:
    sc = panel.site_counts(population)
    return bool(sc.where(F.col("n0") < len(panel.columns(population))).limit(1).count())


def haplotype_keys(panel: Panel, population=None) -> DataFrame:
    """``hap, key``: equal keys for haplotypes that agree at every site (complete data)."""
    cols = list(panel.columns(population))

    def chunks(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = np.ascontiguousarray(allele_matrix(b.column("alleles"))[:, cols].T)
            at = f"{b.column('chrom')[0]}:{b.column('pos')[0]}"
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), pa.array([at] * len(cols)), pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in m], pa.binary())], ["hap", "at", "part"])

    # positions have to come in the same batches for all haplotypes: they do, a batch holds all of them
    found = panel.variants.select("chrom", "pos", "alleles").mapInArrow(chunks, "hap int, at string, part binary")
    joined = F.array_sort(F.collect_list(F.struct("at", "part")))
    return found.groupBy("hap").agg(F.sha2(F.concat_ws(",", F.transform(joined, lambda x: F.hex(x["part"]))).cast("binary"), 256).alias("key"))


def haplotype_frequencies(panel: Panel, population=None) -> np.ndarray:
    """Frequencies of distinct haplotypes, largest first."""
    if _has_missing(panel, population):
        return cluster_frequencies(rows_of(panel.variants, cols=panel.columns(population)))
    counts = [r.n for r in haplotype_keys(panel, population).groupBy("key").agg(F.count("*").alias("n")).collect()]
    n = sum(counts)
    if not n:  # no sites: all haplotypes agree
        return np.ones(1) if panel.columns(population) else np.zeros(0)
    return np.sort(np.array(counts) / n)[::-1]


def _site_hashes(chrom: pa.Array, pos: np.ndarray, seed: int) -> np.ndarray:
    """64 bits by site (the finaliser of splitmix64)."""
    names, at = np.unique(np.array(chrom.to_pylist(), object).astype(str), return_inverse=True)
    own = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{c}".encode(), digest_size=8).digest(), "little") for c in names], np.uint64)
    x = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + own[at]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _added(batches):
    """Sums by individual of a partition, modulo 2^64."""
    held = list(batches)
    if held:
        t = pa.Table.from_batches(held)
        _, at = np.unique(t["ind"].to_numpy(), return_inverse=True)
        x = np.zeros((2, at.max() + 1), np.int64)
        for own, c in zip(x, ("x", "y")):
            np.add.at(own, at, t[c].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["x", "y"])


def diplotype_frequencies(panel: Panel, population=None) -> np.ndarray:
    """Frequencies of distinct multi-site dosages, largest first."""
    rows, matrix, k = dosage_rows(panel, population)
    if _has_missing(panel, population):
        return cluster_frequencies(rows_of(dosages(panel, population), "g"))

    def sums(batches):
        total = np.zeros((2, k), np.int64)
        for b, g in pieces(batches, matrix, 2 * k):
            w = np.stack([_site_hashes(b.column("chrom"), b.column("pos").to_numpy(), seed) for seed in (0, 1)]).view(np.int64)
            total += w @ g.astype(np.int64)  # modulo 2^64
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total[0]), pa.array(total[1])], ["ind", "x", "y"])

    whole = rows.mapInArrow(sums, "ind long, x long, y long").repartition("ind").mapInArrow(_added, "x long, y long")
    counts = [r.n for r in whole.groupBy("x", "y").agg(F.count("*").alias("n")).collect()]
    return np.sort(np.array(counts) / k)[::-1] if k else np.zeros(0)


def garud(f: np.ndarray) -> tuple[float, float, float, float]:
    """H1, H12, H123 and H2/H1 of haplotype frequencies, largest first."""
    sq = f**2
    h1 = float(sq.sum())
    merged = lambda k: float(f[:k].sum() ** 2 + sq[k:].sum())
    return h1, merged(2), merged(3), (h1 - float(sq[:1].sum())) / h1 if h1 else float("nan")


def garud_h(panel: Panel, population=None, missing_data: str = "include", diploid: bool = False):
    """H1, H12, H123 and H2/H1 of haplotypes, or of multi-site dosages."""
    if missing_data == "exclude":
        panel = panel.complete_only(population)
    if diploid:
        from .panel import dosages

        return garud(cluster_frequencies(rows_of(dosages(panel, population), "g")))
    return garud(haplotype_frequencies(panel, population))
