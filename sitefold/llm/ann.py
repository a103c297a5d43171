"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves. Each half has a codebook (k-means on a bounded
sample); a vector's cell is its pair of codes. A query walks through pairs of
codes by growing sum of its halves' distances, which a heap delivers in order,
until the cells passed hold a share ``PROBE`` of all vectors. Entries of those
cells are ranked by exact distance.

The driver holds codebooks and the count of entries per cell, at most the square
of the codebook, whose size grows with the vectors from ``CODES`` to ``MOST_CODES``.
Entries lie in blocks of one first code, about ``BLOCK_ROWS`` each, hot codes in many
blocks; queries are grouped per first code likewise, with a bit set of the second
codes they visit. Query blocks are copied to each entry block of their code, and the
exchange is by (code, entry block), so a hot code is spread over as many tasks as it
has blocks. A block meets the queries that visit it and returns the nearest of each,
so memory is bounded by the block sizes.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length isn't the most frequent one;
of rows that repeat a vec_id the smallest vector takes part; null vec_id takes
no part; ties of distance go to the smaller vec_id; a query with fewer candidates
returns what there is; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, worker

TRAIN, CODES, MOST_CODES, PROBE = 16_384, 64, 512, 0.55
BLOCK_ROWS, BLOCK_QUERIES, PAIR_ROWS, K = 2048, 256, 16, 10


def codebook_size(n: int) -> int:
    """Centroids for each half of ``n`` vectors: in proportion to the square root, so that a cell keeps about as many."""
    return min(MOST_CODES, max(CODES, int(n**0.5 / 4)))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of ``x``; empty ones move to the points farthest off."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        d = nearest_table(x, c)
        code = d.argmin(axis=1)
        n = np.bincount(code, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, code, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[np.argsort(-d.min(axis=1))[: (n == 0).sum()]]
    return c


def nearest_table(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


class MultiIndex:
    """Two codebooks; bounded by ``codes`` rows each."""

    def __init__(self, sample: np.ndarray, codes: int = CODES):
        self.half = max(1, sample.shape[1] // 2)
        k = max(1, min(codes, len(sample) // 8 or 1))
        self.books = [kmeans(p, k) if p.shape[1] else np.zeros((1, 0)) for p in (sample[:, : self.half], sample[:, self.half :])]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(nearest_table(p, b).argmin(axis=1) for p, b in zip((x[:, : self.half], x[:, self.half :]), self.books))

    def walk(self, q: np.ndarray):
        """Pairs of codes by growing summed distance."""
        d = [nearest_table(p[None], b)[0] for p, b in zip((q[: self.half], q[self.half :]), self.books)]
        o = [np.argsort(x, kind="stable") for x in d]
        a, b = (x[y].tolist() for x, y in zip(d, o))
        # one entry per row of the sorted table: a row's next pair comes when its last has gone
        heap, opened = [(a[0] + b[0], 0, 0)], 1
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(o[0][i]), int(o[1][j])
            if j == 0 and opened < len(a):
                heapq.heappush(heap, (a[opened] + b[0], opened, 0))
                opened += 1
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))

    def visits(self, q: np.ndarray, counts: np.ndarray, want: float) -> np.ndarray:
        """Which cells (codes by codes) hold the first ``want`` entries, and ``K`` more than none."""
        out, got = np.zeros(counts.shape, bool), 0
        for i, j in self.walk(q):
            if counts[i, j]:
                out[i, j] = True
                got += counts[i, j]
                if got >= want:
                    break
        return out


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _assign(index: MultiIndex):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            i, j = index.codes(x)
            rows = [pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *rows], ["vec_id", "i", "j", "x"])

    return worker(run)


def _visit(index: MultiIndex, counts: np.ndarray, want: float):
    def run(batches):
        for b in batches:
            ids, code, bits, vec = [], [], [], []
            for q, x in zip(b.column("vec_id").to_pylist(), b.column("x").to_pylist()):
                seen = index.visits(np.frombuffer(x), counts, want)
                for i in np.flatnonzero(seen.any(axis=1)).tolist():
                    ids.append(q), code.append(i), bits.append(np.packbits(seen[i]).tobytes()), vec.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(code, pa.int32()), pa.array(bits, pa.binary()), pa.array(vec, pa.binary())], ["query_id", "i", "cells", "q"])

    return worker(run)


def _rank(k: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q = np.frombuffer(b"".join(x["q"] for x in row["queries"])).reshape(len(row["queries"]), -1)
                e = np.frombuffer(b"".join(x["x"] for x in row["entries"])).reshape(len(row["entries"]), -1)
                eid = np.array([x["vec_id"] for x in row["entries"]], np.int64)
                j = np.array([x["j"] for x in row["entries"]], np.int64)
                out = ([], [], [])
                for n, query in enumerate(row["queries"]):
                    may = np.unpackbits(np.frombuffer(query["cells"], np.uint8))[j].astype(bool) & (eid != query["query_id"])
                    if not may.any():
                        continue
                    d = np.sqrt(((e[may] - q[n]) ** 2).sum(axis=1))
                    near = np.lexsort((eid[may], d))[:k]
                    out[0].extend([query["query_id"]] * len(near)), out[1].extend(eid[may][near].tolist()), out[2].extend(d[near].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return worker(run)


def search(vectors: DataFrame, every: int = 100, k: int = K, probe: float = PROBE, codes: int | None = None, train: int = TRAIN) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` of each vector whose id ``every`` divides."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kept = cut(usable(vectors))
    dims = kept.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    kept = kept.where(F.size("v") == dims.dim)
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train).select("v").toArrow()
    index = MultiIndex(_matrix(sample.column("v").combine_chunks()), codes or codebook_size(dims.n))
    entries = cut(kept.mapInArrow(_assign(index), "vec_id long, i int, j int, x binary"))
    counts = np.zeros(tuple(map(len, index.books)), np.int64)
    for r in entries.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # a row per cell
        counts[r.i, r.j] = r.n
    want = max(probe * counts.sum(), k + 1)
    blocks = {i: -(-int(n) // BLOCK_ROWS) for i, n in enumerate(counts.sum(axis=1))}
    lookup = F.create_map(*[F.lit(x) for i, n in blocks.items() for x in (i, max(1, n))])
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(lookup, F.col("i")))
    eb = entries.groupBy("i", part.alias("part")).agg(F.collect_list(F.struct("vec_id", "j", "x")).alias("entries"))
    asked = entries.where(F.col("vec_id") % every == 0)
    asked = cut(asked.repartition(max(8, spark.sparkContext.defaultParallelism), "vec_id").mapInArrow(_visit(index, counts, want), "query_id long, i int, cells binary, q binary"))
    n_queries = {r.i: r.n for r in asked.groupBy("i").agg(F.count("*").alias("n")).collect()}
    if not n_queries:
        return spark.createDataFrame([], schema)
    lookup_q = F.create_map(*[F.lit(x) for i, n in n_queries.items() for x in (i, -(-n // BLOCK_QUERIES))])
    qb = asked.groupBy("i", F.pmod(F.xxhash64("query_id"), F.element_at(lookup_q, F.col("i"))).alias("qpart")).agg(F.collect_list(F.struct("query_id", "cells", "q")).alias("queries"))
    last = F.element_at(lookup, F.col("i")) - 1
    qb = qb.withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("i", F.col("part").cast("long"), "queries")
    pairs = eb.select("i", F.col("part").cast("long"), "entries").join(qb, ["i", "part"]).select("entries", "queries")
    # a row is a pair of blocks, so a few of them make a batch
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PAIR_ROWS)
    try:
        found = cut(pairs.mapInArrow(_rank(k), "query_id long, vec_id long, score double"))
    finally:
        spark.conf.set(setting, before)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"))
