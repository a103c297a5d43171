"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed in Arrow batches and reduced to the distinct ones. These
are cut into tiles in order of a number that near ones can't differ much in: the
population count, which differs by at most as many as bits differ. Two tiles meet
only if their ranges of that number allow it; a pair of tiles is a cell, a task of
its own, and each tile is sent to the cells of its row and column. In a cell numpy
takes exclusive-or and bit counts. A cell returns a spanning forest of the links it
found: all classes, few rows. Classes are joined by star contraction (few links in one task).

:func:`drop_near_duplicates` removes documents whose texts' word shingles are alike
(Jaccard similarity). Its fingerprints have 512 bits, so that hardly a pair at the
similarity lies beyond the radius (see ``WIDE``) and few others lie within, and its
tiles are in order of the number of shingles, which bounds the similarity. A first
pass over the cells returns the texts that have a candidate, cell by cell; no pairs.
These texts' whole shingle sets then meet in the same cells (heavy ones cut in
blocks), where every candidate pair is verified unless verified links already put
both in one class, and only a spanning forest of verified links leaves the task.

Defined cases: null text is empty; a text without words has fingerprint zero
and is linked like any other; texts of fewer words than a shingle are one
shingle; repeated doc_ids each get a row; a null doc_id gets a row, and is never
chosen as the smallest; an empty table gives an empty result; further columns
are ignored by :func:`near_duplicates` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, discard, small_batches, table, unused, worker

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a tile (a cell holds two), and rows of a tile that travel together.
TILE, CHUNK = 1 << 16, 1024
#: Pairs compared at once.
PAIRS = 1 << 18
#: Words of 64 bits in a wide fingerprint. A bit differs with probability 0.152 between two
#: texts of similarity 0.8 (0.162 at most, by the exact distribution for small sets; 0.1875
#: for 4 and 5 shingles). A pair is a candidate if the first word differs in FIRST bits at
#: most and all in NEAR: 4.2 standard deviations above the mean, for sets of FEW or less ALIKE.
WIDE, FIRST, NEAR, FEW, ALIKE = 8, 22, 112, 8, 130
#: Distinct links whose classes one task finds, in some 100 MB.
AT_ONCE = 1 << 20
#: Shingles in a block of a cell whose sets are compared, and a text's share beside them.
BLOCK, EACH = 1 << 22, 64
#: Characters split into words at once.
PIECE = 1 << 20
_SPACE = re.compile("[\\x09-\\x0d\\x20]")
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1) for k in range(WIDE)], np.uint64)


def word_lists(text: str | None):
    """Words (bytes, A-Z lower-cased) piece by piece; pieces end at white space."""
    text, at = text or "", 0
    while at < len(text):
        end = _SPACE.search(text, at + PIECE)
        end = end.start() if end else len(text)
        yield text[at:end].encode().lower().split()
        at = end


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits; bit set if it is in over half of the shingles' hashes."""
    digest, ones, count, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for parts in word_lists(text):
        parts = tail + parts
        n = len(parts) - words + 1
        if n > 0:
            joined = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist())
            while piece := [digest(joined[a:b], SEED) for a, b in islice(spans, 1 << 15)]:
                ones += bit_sums(np.array(piece, np.uint64)[:, None])
            count += n
        tail = parts[max(0, n) :]
    if not count:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of ``h`` (rows by 64-bit words)."""
    bits = np.unpackbits(h.view(np.uint8).ravel(), bitorder="little").view(np.uint64).reshape(len(h), -1)
    # eight counters of a byte in each number
    return sum(bits[k : k + 255].sum(axis=0).view(np.uint8).astype(np.int64) for k in range(0, len(h), 255))


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            out = np.array([fingerprint(x.as_py(), words) for x in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return worker(run)


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_fingerprints(words), "doc_id long, fp long")


# -- links and classes ------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b (values of any kind) a spanning forest: each node but a root, and its class's root."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


@worker
def _roots(batches):
    """All links in one task: each linked node and the smallest of its class."""
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if links:
        node, root = forest(*(np.concatenate(x) for x in zip(*links)))
        # a root's children all name it, the smallest; itself is no child
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + (1 << 16)]), pa.array(root[k : k + (1 << 16)])], ["node", "root"])


def classes(links: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """``node, root`` of every linked node but the roots; ``root`` is the smallest node of its class.

    Up to ``at_once`` distinct links (counted) are joined up in one task. More take
    large-star and small-star steps in turn, until nothing changes; if that takes
    more than ``rounds``, an error. A node's minimum is aggregated on the map side
    and written, so that a hub's rows meet it in a join of two scanned tables, whose
    large partitions Spark splits (``spark.sql.adaptive.skewJoin.enabled``).
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    if edges.count() <= at_once:
        out = cut(edges.coalesce(1).mapInArrow(_roots, "node long, root long"))
        discard(edges)
        return out
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        discard(edges, low, large, least)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"classes still changed after {rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._cut_path = edges._cut_path
    return out


# -- tiles and cells ----------------------------------------------------------------


@worker
def _packed(batches):
    """Rows of a tile (all columns but the first, ``tile``, are longs), ``CHUNK`` at a time: ``tile, data``."""
    held: dict[int, list] = {}
    size: dict[int, int] = {}
    total = 0

    def out(tiles):
        rows = [(t, np.concatenate(held.pop(t)).tobytes()) for t in tiles]
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["tile", "data"])

    for b in batches:
        if not b.num_rows:
            continue
        tile = b.column(0).to_numpy(zero_copy_only=False)
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
        order = np.argsort(tile, kind="stable")
        tile, rows = tile[order], rows[order]
        cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        for lo, hi in zip(np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(tile)).tolist()):
            t = int(tile[lo])
            held.setdefault(t, []).append(rows[lo:hi])
            size[t] = size.get(t, 0) + hi - lo
            total += hi - lo
        full = [t for t, n in size.items() if n >= CHUNK]
        if total > 64 * CHUNK:
            full = [*size]
        if full:
            total -= sum(size.pop(t) for t in full)
            yield out(full)
    if held:
        yield out([*held])


def _by_cell(batches, width: int):
    """Cells, one after the other, and the rows of their two tiles; the second is None where a tile meets itself."""
    now, parts = None, ([], [])

    def tiles():
        x, y = (np.concatenate(p).reshape(-1, width) if p else None for p in parts)
        return x, y

    for b in batches:
        for cell, side, data in zip(b.column("cell").to_pylist(), b.column("side").to_pylist(), b.column("data")):
            if cell != now and now is not None:
                yield now, *tiles()
                parts = ([], [])
            now = cell
            parts[side].append(np.frombuffer(data.as_py(), np.int64))
    if now is not None:
        yield now, *tiles()


def grid(rows: DataFrame, band, meets, run, schema: str, tile: int = TILE) -> DataFrame:
    """What ``run`` finds in the cells of ``rows``, whose columns are longs.

    ``band`` is a small whole number by which tiles are ordered (of few values, which
    the driver counts), and ``meets(a, b)`` says if rows of band ``a`` may be near some
    of band ``b >= a``; if not, none of ``a`` is near any above ``b``. ``run`` gets a
    cell's number and its two matrices, the second None where a tile meets itself.
    """
    spark, columns = rows.sparkSession, rows.columns
    b, t = unused(columns, "band"), unused(columns, "tile")
    d = rows.select(band.cast("int").alias(b), *columns)
    count = {r[b]: r.n for r in d.groupBy(b).agg(F.count("*").alias("n")).collect()}
    if not count:
        return spark.createDataFrame([], schema)
    total = sum(count.values())
    # as many tiles as their size asks for, or as keep the cores busy
    n_tiles = max(-(-total // tile), min(-(-total // 512), int(2 * spark.sparkContext.defaultParallelism**0.5) + 2))
    low, high, start, at = [None] * n_tiles, [None] * n_tiles, [], 0
    for k in sorted(count):
        start += [F.lit(k), F.struct(F.lit(float(at)), F.lit(float(count[k])))]
        for i in range(at * n_tiles // total, min(n_tiles - 1, (at + count[k]) * n_tiles // total) + 1):
            low[i] = k if low[i] is None else low[i]
            high[i] = k
        at += count[k]
    last, u = [], 0
    for i in range(n_tiles):
        u = max(u, i)
        while u + 1 < n_tiles and meets(high[i], low[u + 1]):
            u += 1
        last.append(u)
    first, base, s = [], [], 0
    for i in range(n_tiles):
        while last[s] < i:
            s += 1
        first.append(s)
        base.append(sum(last[j] - j + 1 for j in range(max(0, i - 1), i)) + (base[-1] if base else 0))
    n_cells = base[-1] + last[-1] - n_tiles + 2
    here = F.element_at(F.create_map(*start), F.col(b))
    share = F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20)
    place = F.floor((here["col1"] + share * here["col2"]) * n_tiles / total)
    d = d.select(F.least(place, F.lit(n_tiles - 1)).cast("int").alias(t), *columns)
    chunks = d.mapInArrow(_packed, "tile int, data binary")
    info = F.broadcast(spark.createDataFrame([(i, first[i], last[i], base[i] - i) for i in range(n_tiles)], "tile int, first int, last int, base long"))
    own = chunks.join(info, "tile").select("base", F.explode(F.sequence("tile", "last")).alias("to"), "data").select((F.col("base") + F.col("to")).alias("cell"), F.lit(0).alias("side"), "data")
    other = chunks.join(info, "tile").where("first < tile").select(F.explode(F.sequence("first", F.col("tile") - 1)).alias("row"), F.col("tile").alias("to"), "data")
    rows_info = F.broadcast(spark.createDataFrame([(i, base[i] - i) for i in range(n_tiles)], "row int, base long"))
    other = other.join(rows_info, "row").select((F.col("base") + F.col("to")).alias("cell"), F.lit(1).alias("side"), "data")
    # a cell is a partition of its own
    p = min(n_cells, 20_000)
    dealt = own.unionByName(other).withColumn("p", (F.col("cell") % p).cast("int")).repartitionById(p, "p")
    return dealt.sortWithinPartitions("cell", "side").select("cell", "side", "data").mapInArrow(_cells(run, len(columns)), schema)


def _cells(run, width: int):
    def task(batches):
        for cell, x, y in _by_cell(batches, width):
            if x is not None:
                yield from run(cell, x, y)

    return worker(task)


# -- 64 bits: the operator ------------------------------------------------------------


def _parts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int8)


def _runs(fp: np.ndarray):
    """``fp`` ordered by its parts' counts; the runs' counts and bounds."""
    p = _parts(fp)
    order = np.lexsort(p.T)
    p, fp = p[order], fp[order]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]).any(axis=1))))
    return fp, p[first], first, np.append(first[1:], len(fp))


def compare(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile with another (or itself) at ``radius`` or fewer differing bits.

    Runs of equal counts in the four parts of 16 bits are skipped by the same bound
    that rules out tiles: the counts' differences add up to no more than the bits'.
    """
    if not len(a) or not len(b):
        return a[:0], b[:0]
    a, pa_, s, e = _runs(a)
    b, pb, bs, be = _runs(b)
    left, right = [], []
    for k in range(len(s)):
        near = np.flatnonzero(np.abs(pb - pa_[k]).sum(axis=1, dtype=np.int16) <= radius)
        if not len(near):
            continue
        n = be[near] - bs[near]
        at = np.repeat(bs[near] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        other = b[at]
        step = max(1, PAIRS // len(other))
        for lo in range(s[k], e[k], step):
            own = a[lo : min(e[k], lo + step)]
            i, j = np.nonzero(np.bitwise_count(own[:, None] ^ other[None, :]) <= radius)
            if len(i):
                left.append(own[i])
                right.append(other[j])
        if sum(map(len, left)) > 1 << 20:  # dense classes: keep their forest only
            x, y = forest(np.concatenate(left), np.concatenate(right))
            left, right = [x], [y]
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], b[:0])


def _links(radius: int):
    def run(_, x, y):
        x = x.ravel().view(np.uint64)
        u, v = compare(x, x if y is None else y.ravel().view(np.uint64), radius)
        keep = u != v
        u, v = forest(u[keep], v[keep])
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def tile_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints ``fp``: every class, not every pair."""
    return grid(distinct.select("fp"), F.bit_count("fp"), lambda a, b: b - a <= radius, _links(radius), "u long, v long", tile)


def components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fp, component_id`` of each distinct fingerprint of ``prints(doc_id, fp)``."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = classes(tile_links(distinct, radius, tile))
    with_root = cut(distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = cut(with_root.groupBy("root").agg(F.min("first").alias("component_id")))
    out = cut(with_root.join(lowest, "root").select("fp", "component_id"))
    discard(distinct, found, with_root, lowest)
    return out


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id``: one row per document."""
    small_batches(documents.sparkSession)
    prints = cut(fingerprints(documents, words))
    return prints.join(components(prints, radius, tile), "fp").select("doc_id", "fp", "component_id")


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- 512 bits and verified similarity: the stage -------------------------------------------


class _Hashes(dict):
    """64-bit hashes by word, for the words met; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mixed(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(32))
    z *= _C[2]
    z ^= z >> np.uint64(29)
    z *= _C[1]
    return z ^ (z >> np.uint64(32))


def shingle_hashes(text: str | None, words: int, memo: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    lists = [np.fromiter(map(memo.__getitem__, p), np.uint64, len(p)) for p in word_lists(text)]
    w = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.full(n, min(len(w), words), np.uint64)
    for k in range(min(len(w), words)):
        h = _mixed(h * _C[0] + w[k : k + n])
    return np.unique(h)


def wide_print(s: np.ndarray) -> np.ndarray:
    """``WIDE`` words of 64 bits from a set of hashes: bit set if it is in over half of them, each hash mixed anew for each word."""
    ones = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(s), 1 << 14):
        ones += bit_sums(_mixed(s[k : k + (1 << 14), None] * _ODD[None, :]))
    return np.packbits(ones * 2 > len(s), bitorder="little").view(np.int64)


_WORDS = [f"w{k}" for k in range(WIDE)]


def _wide(words: int):
    """Each document's node (texts of equal shingle sets are one), its number of shingles and its fingerprint."""

    def run(batches):
        memo = _Hashes()
        for b in batches:
            sets = [shingle_hashes(x.as_py(), words, memo) for x in b.column("text")]
            prints = np.stack([wide_print(s) for s in sets]) if sets else np.zeros((0, WIDE), np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            size = np.array(list(map(len, sets)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(node), pa.array(size), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WIDE))], ["doc_id", "h", "node", "n", *_WORDS])

    return worker(run)


def _sets(words: int):
    """The wanted texts' sorted distinct shingle hashes, packed, beside the other columns but the text."""

    def run(batches):
        memo = _Hashes()
        for b in batches:
            out = [shingle_hashes(x.as_py(), words, memo).tobytes() for x in b.column("text")]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], [*names, "s"])

    return worker(run)


def near_pairs(a: np.ndarray, b: np.ndarray | None, similarity: float):
    """Places ``i, j`` of candidate pairs of two tiles (or, ``i < j``, of one) and their differing bits, some at a time.

    Rows are ``w0..., node, n`` in order of ``n``. Pairs whose numbers of shingles rule out the similarity are none.
    """
    n, same = WIDE + 1, b is None
    b = a if same else b
    wa, wb = (np.ascontiguousarray(t[:, :WIDE]).view(np.uint64) for t in (a, b))
    fa, fb = np.ascontiguousarray(wa[:, 0]), np.ascontiguousarray(wb[:, 0])
    at = 0
    while at < len(a):
        lo = at + 1 if same else np.searchsorted(b[:, n], np.ceil(a[at, n] * similarity - 1e-6))
        most = len(a) - at
        while True:  # as many rows as give PAIRS pairs; a later row reaches farther
            to = at + most
            hi = np.searchsorted(b[:, n], np.floor(a[to - 1, n] / similarity + 1e-6), "right")
            if most == 1 or most * (hi - lo) <= PAIRS:
                break
            most = max(1, min(most // 2, PAIRS // max(1, hi - lo)))
        for c in range(lo, hi, PAIRS):
            i, j = np.nonzero(np.bitwise_count(fa[at:to, None] ^ fb[None, c : min(hi, c + PAIRS)]) <= FIRST)
            i, j = i + at, j + c
            p, q = a[i, n], b[j, n]
            fine = np.minimum(p, q) >= similarity * np.maximum(p, q) - 1e-6
            if same:
                fine &= i < j
            i, j = i[fine], j[fine]
            bits = np.bitwise_count(wa[i] ^ wb[j]).sum(axis=1, dtype=np.int64)
            fine = bits <= np.where(np.minimum(a[i, n], b[j, n]) <= FEW, ALIKE, NEAR)
            if fine.any():
                yield i[fine], j[fine], bits[fine]
        at = to


def _by_size(x: np.ndarray) -> np.ndarray:
    return x[np.argsort(x[:, WIDE + 1], kind="stable")]


def _involved(similarity: float):
    """A cell's texts that have a candidate in it: ``cell, alone, side, node, n``."""

    def run(cell, x, y):
        a, b = _by_size(x), None if y is None else _by_size(y)
        hit = [np.zeros(len(a), bool)]
        hit.append(hit[0] if b is None else np.zeros(len(b), bool))
        for i, j, _ in near_pairs(a, b, similarity):
            hit[0][i], hit[1][j] = True, True
        for side, t in ((0, a),) if b is None else ((0, a), (1, b)):
            node, n = t[hit[side], WIDE], t[hit[side], WIDE + 1]
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), cell)), pa.array(np.full(len(node), y is None)), pa.array(np.full(len(node), side, np.int32)), pa.array(node), pa.array(n)], ["cell", "alone", "side", "node", "n"])

    return run


def involved(nodes: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """``cell, alone, side, node, n``: of ``nodes(w0..., node, n)`` those with a candidate, by cell; ``alone``: a tile meets itself."""
    steps = 16  # bands of shingle numbers an octave
    band = F.floor(F.log2(F.col("n") + 1.0) * steps)
    least = lambda k: 2 ** (k / steps) - 1
    meets = lambda a, b: least(a + 1) >= similarity * least(b) - 1e-6
    return grid(nodes.select(*_WORDS, "node", "n"), band, meets, _involved(similarity), "cell long, alone boolean, side int, node long, n long", tile)


class _Classes:
    """Classes of places; of two that meet, the smaller takes the other's label."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {}

    def join(self, i: int, others: np.ndarray):
        """Puts the classes of ``others`` and of ``i`` together; yields those places that were of another class."""
        for j in others.tolist():
            p, q = int(self.label[i]), int(self.label[j])
            if p == q:
                continue
            x, y = self.members.pop(p, [p]), self.members.pop(q, [q])
            if len(x) < len(y):
                p, x, y = q, y, x
            self.label[y] = p
            x.extend(y)
            self.members[p] = x
            yield j


def verified_links(a: np.ndarray, sets_a: list, b: np.ndarray | None, sets_b: list | None, similarity: float):
    """Nodes ``u, v`` of a spanning forest of the verified links of two blocks (or of one), in which every candidate pair is settled."""
    order = np.argsort(a[:, WIDE + 1], kind="stable")
    a, sets = a[order], [sets_a[k] for k in order.tolist()]
    shift, node = 0, a[:, WIDE]
    if b is not None:
        order = np.argsort(b[:, WIDE + 1], kind="stable")
        b, shift = b[order], len(a)
        sets += [sets_b[k] for k in order.tolist()]
        node = np.concatenate((node, b[:, WIDE]))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)
    known = _Classes(len(sets))
    for i, j, bits in near_pairs(a, b, similarity):
        j = j + shift
        order = np.lexsort((bits, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for x, y in zip(first.tolist(), np.append(first[1:], len(i)).tolist()):
            own, others, take = int(i[x]), j[x:y], 8
            mine = code[start[own] : start[own] + size[own]]
            mark[mine] = 1
            # the nearest first: once they put the text in their class, most of the others are in it too
            while True:
                others = others[known.label[others] != known.label[own]]
                if not len(others):
                    break
                some, others = others[:take], others[take:]
                n = size[some]
                ends = np.cumsum(n)
                at = np.repeat(start[some] - (ends - n), n) + np.arange(ends[-1])
                both = np.add.reduceat(mark[code[at]], ends - n)
                linked = some[both >= similarity * (n + size[own] - both) - 1e-9]
                for k in known.join(own, linked):
                    yield int(node[own]), int(node[k])
                take = max(1, min(take * 8, (1 << 20) // max(1, int(n.max()))))
            mark[mine] = 0


def _verified(similarity: float):
    def run(batches):
        now, rows, sets, out = None, ([], []), ([], []), []

        def links():
            if rows[0]:
                x, y = (np.array(r, np.int64) if r else None for r in rows)
                if now[2] or y is not None:
                    yield from verified_links(x, sets[0], y, sets[1], similarity)

        def batch():
            u, v = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            numbers = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (*_WORDS, "node", "n")], axis=1)
            for k, (cell, r, alone, side, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "r", "alone", "side", "s")))):
                if (cell, r, alone) != now:
                    if now is not None:
                        out.extend(links())
                        if len(out) > 10_000:
                            yield batch()
                    now, rows, sets = (cell, r, alone), ([], []), ([], [])
                rows[side].append(numbers[k])
                sets[side].append(np.frombuffer(s, np.uint64))
        if now is not None:
            out.extend(links())
        if out:
            yield batch()

    return worker(run)


def verified(d: DataFrame, nodes: DataFrame, words: int, similarity: float, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``u, v``: links that span the classes of alike ``nodes``; ``d(doc_id, h, text)`` has their texts."""
    places = cut(involved(nodes, similarity, tile))
    ends = places.select("node").distinct()
    wanted = cut(nodes.join(ends, "node").select(F.col("first").alias("doc_id"), F.col("first_h").alias("h"), "node", "n", *_WORDS))
    texts = d.join(broadcast_if_small(wanted, 160), ["doc_id", "h"]).select("node", "n", *_WORDS, "text")
    numbers = ", ".join(f"{c} long" for c in ("node", "n", *_WORDS))
    sets = cut(texts.mapInArrow(_sets(words), f"{numbers}, s binary"))
    if sets.count() > wanted.count():  # rows that repeat a doc_id and its text
        sets, again = cut(sets.dropDuplicates(["node"])), sets
        discard(again)
    # heavy cells in blocks: block r of the one side meets block s of the other
    weight = cut(places.groupBy("cell").agg(F.ceil(F.sum(F.col("n") + EACH) / block).cast("int").alias("k")))
    p = places.join(broadcast_if_small(weight, 64), "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    up = F.sequence("own", F.col("k") - 1)
    every = F.sequence(F.lit(0), F.col("k") - 1)
    left = p.where("side = 0").select("cell", "k", "alone", "node", F.lit(0).alias("side"), "own", F.explode(F.when(F.col("alone"), up).otherwise(every)).alias("to"))
    left = left.select("cell", (F.col("own") * F.col("k") + F.col("to")).alias("r"), (F.col("alone") & (F.col("own") == F.col("to"))).alias("alone"), "side", "node")
    right = p.where("side = 1 OR alone AND own > 0").select("cell", "k", "node", F.lit(1).alias("side"), "own", F.explode(F.when(F.col("alone"), F.sequence(F.lit(0), F.col("own") - 1)).otherwise(every)).alias("to"))
    right = right.select("cell", (F.col("to") * F.col("k") + F.col("own")).alias("r"), F.lit(False).alias("alone"), "side", "node")
    met = cut(left.unionByName(right)).join(sets, "node").repartition("cell", "r").sortWithinPartitions("cell", "r", "side")
    links = cut(met.mapInArrow(_verified(similarity), "u long, v long"))
    discard(places, wanted, sets, weight)
    return links


def near_groups(documents: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``doc_id, h, lowest`` of documents alike to one of a smaller doc_id; ``h`` is the text's ``xxhash64``."""
    small_batches(documents.sparkSession)
    d = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    prints = cut(d.mapInArrow(_wide(words), "doc_id long, h long, node long, n long, " + ", ".join(f"{w} long" for w in _WORDS)))
    # numbers only, so sums are hashed on the map side: a hot node sends a row per task
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min_by("h", "doc_id").alias("first_h"), F.count("*").alias("docs"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in _WORDS)))
    links = verified(d, nodes, words, similarity, tile, block)
    found = classes(links)
    linked = cut(nodes.select("node", "first", "docs").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = cut(linked.groupBy("root").agg(F.min("first").alias("lowest"), F.sum("docs").alias("docs")).where("docs > 1").drop("docs"))
    asked = cut(linked.join(lowest, "root").select("node", "lowest"))
    out = cut(prints.select("node", "doc_id", "h").join(asked, "node").where("doc_id <> lowest").select("doc_id", "h", "lowest").distinct())
    discard(prints, nodes, links, found, linked, lowest, asked)
    return out


def drop_near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """The documents without those that repeat another of their group, columns and rows otherwise as they came.

    Two texts are linked if the Jaccard similarity of their sets of shingles is
    ``similarity`` or more; of each group so linked the smallest doc_id stays. Two
    texts without words are equal. Rows that repeat a doc_id are judged by their own
    text; those alike to their group's smallest doc_id stay with it. A null doc_id stays.
    """
    i, h = unused(documents.columns, "near_id"), unused(documents.columns, "near_h")
    gone = near_groups(documents, words, similarity, tile, block)
    gone = broadcast_if_small(gone.select(F.col("doc_id").alias(i), F.col("h").alias(h)), 80)
    return documents.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")}).join(gone, [i, h], "left_anti").drop(i, h)
