"""Removal of byte strings that occur in an earlier document.

Two equal strings of ``SPAN`` bytes have the same smallest 16-byte hash (their
minimiser), so only texts that share one need to meet:

1. Every document is cut into runs of window starts with equal minimiser. The
   distinct minimisers, one per minimiser and flush of a task with the number of
   documents behind it, go to buckets, which answer those in several documents.
2. Documents are scanned again with those answers. A run that shares its minimiser
   goes to a bucket with its bytes (the windows and the rest of the last one). A
   run that equals a run of an earlier document in the same flush is settled on the
   spot and not sent. A minimiser behind more than ``HEAVY`` documents has its
   windows sent one by one, by their own hash, so no bucket gathers a hot phrase.
3. A bucket builds an enhanced suffix array (sorted suffixes and common prefixes)
   of its distinct runs, scans it with a stack for the intervals of the common-
   prefix tree, keeps those that can be extended to the left in more than one way
   (maximal repeats), and compares all occurrences of each with the smallest
   doc_id among them. A byte lies in a string of an earlier document exactly if it
   lies in such a repeat.
4. Spans are gathered by document and cut out.

Texts travel twice, to meet the answers and the spans, as compressed Arrow batches
by hash of doc_id; so do runs and answers, packed by bucket. Tasks hold one flush
or one bucket, both bounded; the numbers of buckets and of parts follow the input,
and each is a partition of its own (up to 20,000, which several then share).
The driver holds a total and the heavy minimisers, at most ``MOST_HEAVY``: beyond
that many the limit ``HEAVY`` rises with the input, which changes where a phrase is
compared but not what is found.

Defined cases: null text is empty; a text shorter than ``SPAN`` loses nothing;
rows that repeat a doc_id are one document, none of them earlier than another, and
each loses what its own text shares with a smaller doc_id (spans are kept by doc_id
and the text's ``xxhash64``, the tag); a null doc_id is neither earlier nor later
than any; an empty table gives an empty result; further columns are ignored, or kept
by :func:`drop_repeats`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, small_batches, table, unused, worker

SPAN, GRAM = 50, 16
#: Most windows in a run; bytes of text handled at once; entries, and bytes of runs, held before a flush.
RUN, PART, FLUSH, FLUSH_BYTES = 64, 1 << 18, 1 << 19, 16 << 20
#: Occurrences of repeats handled at once.
OCCURRENCES = 1 << 20
HEAVY, MOST_HEAVY = 20_000, 1_000_000
BUCKET_ENTRIES, PART_BYTES, LEVEL = 1 << 17, 12 << 20, 3
#: Most partitions of an exchange.
MOST_PARTITIONS = 20_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_LOW40 = np.uint64((1 << 40) - 1)


def _gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each offset (offsets too near the end are padded)."""
    n = len(data)
    padded = np.frombuffer(data + b"\0" * 16, np.uint8)
    w = np.ndarray((n + 8,), "<u8", padded, strides=(1,)).copy()
    h = w[:n] * _C[0]
    h ^= h >> np.uint64(29)
    h += w[8:] * _C[1]
    h *= _C[4]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h ^= h >> np.uint64(31)
    return h


def _window_minimum(h: np.ndarray) -> np.ndarray:
    """Minimum of the 35 hashes from each offset, for the offsets that have them."""
    m = h
    for step in (1, 2, 4, 8, 16):
        m = np.minimum(m[:-step], m[step:])
    return np.minimum(m[:-3], m[3:])


def window_runs(data: bytes):
    """Runs of windows with equal minimiser: ``minimiser, first offset, windows``; and the hashes."""
    if len(data) < SPAN:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(0, np.uint64)
    h = _gram_hashes(data)
    m = _window_minimum(h[: len(data) - GRAM + 1])
    new = np.empty(len(m), bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    start = new.nonzero()[0]
    size = np.empty_like(start)
    np.subtract(start[1:], start[:-1], out=size[:-1])
    size[-1] = len(m) - start[-1]
    if size.max() > RUN:
        n = -(-size // RUN)
        base = np.repeat(start, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end = np.repeat(start + size, n)
        start = base + k * RUN
        size = np.minimum(end - start, RUN)
    return m[start], start, size, h


def parts(data: bytes):
    """A long text in parts that overlap by all but one byte of a window: ``(offset, bytes)``."""
    if len(data) <= PART:
        yield 0, data
        return
    for at in range(0, len(data) - SPAN + 1, PART - SPAN + 1):
        yield at, data[at : at + PART]


def _bucket_of(m: np.ndarray, buckets: int) -> np.ndarray:
    return (m & np.uint64(0xFFFFFF)) % np.uint64(buckets)


def _short(m: np.ndarray, buckets: int) -> np.ndarray:
    """What is sent of a minimiser: 40 bits, to which a bucket adds 8 of its number. More meetings at worst, none less."""
    return (m >> np.uint64(24)) | ((_bucket_of(m, buckets) & np.uint64(0xFF)) << np.uint64(40))


def _pack40(m: np.ndarray) -> bytes:
    return (m & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((m >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").tobytes()


def _unpack40(b: bytes, bucket: int) -> np.ndarray:
    n = len(b) // 5
    low = np.frombuffer(b, "<u4", n).astype(np.uint64) | (np.frombuffer(b, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32))
    return low | np.uint64((bucket & 0xFF) << 40)


def _pack48(m: np.ndarray) -> bytes:
    return (m & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (m >> np.uint64(32)).astype("<u2").tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | (np.frombuffer(b, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def _order(code: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers; numpy sorts short ones by digits, in a fraction of the time."""
    short = len(code) and code.min() >= 0 and code.max() < 1 << 16
    return np.argsort(code.astype(np.uint16) if short else code, kind="stable")


def _groups(code: np.ndarray):
    """Order by code, distinct codes and their bounds in that order."""
    order = _order(code)
    s = code[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return order, s[first], first, np.append(first[1:], len(s))


def _mix(doc: np.ndarray) -> np.ndarray:
    """A hash of doc_ids, for spreading them over parts."""
    x = doc.astype(np.uint64) * _C[0]
    return x ^ (x >> np.uint64(32))


# -- documents meet what is known of them ---------------------------------------


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packed(n_parts: int, kind: int, limit: int):
    """Rows as compressed Arrow batches by hash of doc_id: ``part, kind, data``."""

    def run(batches):
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["doc_id"].cast(pa.int64()).fill_null(0).to_numpy()
            order, keys, a, b = _groups(_mix(ids) % np.uint64(n_parts))
            rows = t.take(pa.array(order))
            out = [_ipc(rows.slice(x, y - x).combine_chunks().to_batches()[0]) for x, y in zip(a.tolist(), b.tolist())]
            held.clear()
            del t, rows
            pa.default_memory_pool().release_unused()
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 64].astype(np.int32)), pa.array([kind] * len(out[k : k + 64]), pa.int32()), pa.array(out[k : k + 64], pa.binary())], ["part", "kind", "data"])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                held.append(b.slice(at, 2000))
                size += held[-1].get_total_buffer_size() if b.num_rows <= 2000 else held[-1].nbytes
                if size > limit:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return worker(run)


def _meeting(f, by_doc):
    """``f(known, rows)`` for each batch of documents, with all that is known of its part: what ``by_doc`` makes of that table, by doc_id."""

    def batches_of(batches):
        part, told, known = None, [], {}
        for b in batches:
            for p, kind, data in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("data")):
                if p != part:
                    part, told, known = p, [], {}
                rows = pa.ipc.open_stream(data.as_buffer()).read_all()
                if not kind:
                    told.append(rows)
                    continue
                if told:  # what is known of a part comes before its documents
                    known = by_doc(pa.concat_tables(told))
                    told = []
                for r in rows.to_batches():
                    yield known, r

    return worker(lambda batches: f(batches_of(batches)))


_PACKED = "part int, kind int, data binary"


def _packed_known(n_parts: int, f):
    """Packed rows of what ``f`` finds, in the same worker: an idle one would hold its memory."""
    pack = _packed(n_parts, 0, 8 << 20)
    return worker(lambda batches: pack(f(batches)))


def meet(documents: DataFrame, known: DataFrame, n_parts: int, by_doc, f, schema) -> DataFrame:
    """Run ``f`` over documents together with what the packed rows ``known`` say of them, by ``by_doc``."""
    d = documents.mapInArrow(_packed(n_parts, 1, 16 << 20), _PACKED)
    both = _dealt(known.unionByName(d), n_parts, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(_meeting(f, by_doc), schema)


def _dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows of each key, a number below ``n``, in a partition of their own."""
    return rows.repartitionById(min(n, MOST_PARTITIONS), (F.col(key) % min(n, MOST_PARTITIONS)).cast("int"))


# -- 1: minimisers ------------------------------------------------------------


def _doc_texts(batches):
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            if doc is not None and text.is_valid:
                data = text.as_buffer().to_pybytes()
                if len(data) >= SPAN:
                    yield doc, data


def _scan(buckets: int):
    def run(batches):
        found, held = [], 0

        def flush():
            found.sort(key=lambda x: x[0])
            n = [len(x) for _, x in found]
            docs, rank = np.array([doc for doc, _ in found], np.int64), np.repeat(np.arange(len(n)), n)
            m = np.concatenate([x for _, x in found])
            order = np.argsort(m, kind="stable")  # by document among equal ones
            rank, m = rank[order], m[order]
            d = docs[rank]
            fresh = np.concatenate(([True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])))
            rank, d, m = rank[fresh], d[fresh], m[fresh]
            first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            count = np.diff(np.append(first, len(m)))
            shared = np.repeat(count > 1, count)
            out = []
            # one of each minimiser asks; those in several documents of this flush are known already
            order = _order(rank[first])
            to, keys, a, b = _groups(_bucket_of(m[first][order], buckets))
            order = order[to]
            dd, mm, cc = d[first][order], m[first][order], count[order]
            for k, x, y in zip(keys.tolist(), a.tolist(), b.tolist()):
                out.append((k, 0, dd[x:y].tobytes(), _pack40(mm[x:y] >> np.uint64(24)), np.minimum(cc[x:y], 65535).astype("<u2").tobytes()))
            order = np.flatnonzero(shared)[_order(rank[shared])]
            dd, mm = d[order], _short(m[order], buckets)
            order, keys, a, b = _groups(_mix(dd) % np.uint64(buckets))
            for k, x, y in zip(keys.tolist(), a.tolist(), b.tolist()):
                i = order[x:y]
                out.append((k, 1, dd[i].tobytes(), _pack48(mm[i]), b""))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "known", "docs", "ms", "counts"])

        for doc, data in _doc_texts(batches):
            for _, part in parts(data):
                m = window_runs(part)[0]
                found.append((doc, m))
                held += len(m)
            if held > FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    return worker(run)


def _by_bucket(batches, columns):
    """Rows of one bucket after the other, from rows in order of buckets: ``bucket, rows``."""
    now, rows = None, []
    for b in batches:
        for row in zip(b.column("bucket").to_pylist(), *(b.column(c) for c in columns)):
            if row[0] != now and rows:
                yield now, rows
                rows = []
            now = row[0]
            rows.append([x.as_py() for x in row[1:]])
    if rows:
        yield now, rows


def _answer(heavy: int, hot: list[bytes]):
    """Shared minimisers with their documents, of one bucket after the other; heavy ones go to ``hot`` as well."""

    def run(batches):
        for bucket, rows in _by_bucket(batches, ("known", "docs", "ms", "counts")):
            for known, d, m, _ in rows:
                if known:
                    yield _answers(np.frombuffer(d, np.int64), _unpack48(m))
            ask = [r for r in rows if not r[0]]
            if not ask:
                continue
            d = np.concatenate([np.frombuffer(r[1], np.int64) for r in ask])
            m = np.concatenate([_unpack40(r[2], bucket) for r in ask])
            c = np.concatenate([np.frombuffer(r[3], "<u2") for r in ask]).astype(np.int64)
            order = np.argsort(m)
            d, m, c = d[order], m[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            size = np.diff(np.append(first, len(m)))
            total, low, high = np.add.reduceat(c, first), np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            if (total > heavy).any():
                hot.append(_pack48(m[first][total > heavy]))
            told = np.repeat((low < high) | (total > size), size) & (c == 1)
            d, m = d[told], m[told]
            order = np.argsort(d)
            yield _answers(d[order], m[order])

    return run


def _answers_packed(heavy: int, n_parts: int):
    """Answers as packed rows for documents to meet, and heavy minimisers as rows of part -1 and kind 2."""
    pack = _packed(n_parts, 0, 8 << 20)

    def run(batches):
        hot: list[bytes] = []
        yield from pack(_answer(heavy, hot)(batches))
        if hot:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(hot), pa.int32()), pa.array([2] * len(hot), pa.int32()), pa.array(hot, pa.binary())], ["part", "kind", "data"])

    return worker(run)


def _answers(d: np.ndarray, m: np.ndarray):
    """A row for each: the 48 bits of a minimiser in two columns."""
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(m.astype(np.uint32)), pa.array((m >> np.uint64(32)).astype(np.uint16))], ["doc_id", "low", "high"])


def _minimisers(told: pa.Table) -> dict[int, np.ndarray]:
    """Shared minimisers by document."""
    order, docs, a, b = _groups(told["doc_id"].to_numpy())
    m = (told["low"].to_numpy().astype(np.uint64) | (told["high"].to_numpy().astype(np.uint64) << np.uint64(32)))[order]
    return {doc: m[x:y] for doc, x, y in zip(docs.tolist(), a.tolist(), b.tolist())}


# -- 2: runs that share a minimiser -------------------------------------------


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Spans of many texts, overlapping and adjacent ones joined up, in order."""
    if not len(doc):
        return doc, tag, a, b
    # rows of a text mostly lie side by side, so such stretches are ranked, and rows ordered by one number
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    at = np.flatnonzero(new)
    order = np.lexsort((tag[at], doc[at]))
    d, g = doc[at[order]], tag[at[order]]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (g[1:] != g[:-1]))))
    base = (rank * (1 << 40))[np.cumsum(new) - 1]
    order = np.argsort(base + a)
    doc, tag, a, b, base = doc[order], tag[order], a[order], b[order], base[order]
    reach = np.maximum.accumulate(base + b)
    at = np.flatnonzero(np.concatenate(([True], (base + a)[1:] > reach[:-1])))
    end = np.append(at[1:], len(doc)) - 1
    return doc[at], tag[at], a[at], reach[end] - base[end]


def _codes() -> dict[bytes, int]:
    """Gives each string that it is asked for a number, from 0 in order of appearance."""
    return defaultdict(itertools.count().__next__)


def _coded(data: bytes, a: np.ndarray, b: np.ndarray, codes: dict[bytes, int]) -> np.ndarray:
    """The codes of these ranges of the data."""
    return np.fromiter(map(codes.__getitem__, map(data.__getitem__, map(slice, a.tolist(), b.tolist()))), np.int64, len(a))


def _lowest(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of each row's code, a number from 0."""
    low = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, code, doc)
    return low[code]


def _runs(buckets: int, heavy: np.ndarray):
    """Runs by bucket, and spans already settled: ``bucket, kind, docs, tags, starts, sizes, data``."""
    names = ["bucket", "kind", "docs", "tags", "starts", "sizes", "data"]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)

    def run(meetings):
        codes = _codes()
        rows: list[tuple] = []  # arrays: code, bucket, doc, tag, offset, bytes
        held = 0

        def flush():
            nonlocal codes
            code, to, doc, tag, at, size = (np.concatenate(x) for x in zip(*rows))
            text = [*codes]
            late = doc > _lowest(code, doc)
            out = []
            d, g, a, b = _merged(doc[late], tag[late], at[late], at[late] + size[late])
            order, keys, lo, hi = _groups(_mix(d) % np.uint64(buckets))
            for k, x, y in zip(keys.tolist(), lo.tolist(), hi.tolist()):
                i = order[x:y]
                out.append((k, 1, d[i].tobytes(), g[i].tobytes(), a[i].tobytes(), (b[i] - a[i]).tobytes(), b""))
            code, to, doc, tag, at, size = (x[~late] for x in (code, to, doc, tag, at, size))
            order, keys, lo, hi = _groups(to)
            squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
            for k, x, y in zip(keys.tolist(), lo.tolist(), hi.tolist()):
                i = order[x:y]
                out.append((k, 0, doc[i].tobytes(), tag[i].tobytes(), at[i].tobytes(), size[i].tobytes(), squeeze(b"".join(map(text.__getitem__, code[i].tolist())))))
            codes = _codes()
            rows.clear()
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64]), kinds)], names)

        for known, b in meetings:
            for doc, tag, text in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text")):
                if doc not in known or not text.is_valid:
                    continue
                wanted = np.sort(known[doc])
                data = text.as_buffer().to_pybytes()
                for base, part in parts(data):
                    m, start, size, h = window_runs(part)
                    if not len(m):
                        continue
                    short = _short(m, buckets)
                    hit = np.flatnonzero(_in(wanted, short))
                    hot = _in(heavy, short[hit])
                    i = hit[~hot]
                    a, z = start[i], start[i] + size[i] + SPAN - 1
                    rows.append((_coded(part, a, z, codes), _bucket_of(m[i], buckets).astype(np.int64), np.full(len(i), doc, np.int64), np.full(len(i), tag, np.int64), a + base, z - a))
                    held += int((z - a).sum()) + 90 * len(i)
                    if hot.any():  # each window by its own hash
                        n = size[hit[hot]]
                        a = np.repeat(start[hit[hot]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        to = ((h[a] * _C[0] ^ h[a + SPAN - GRAM]) * _C[1] >> np.uint64(20)) % np.uint64(buckets)
                        rows.append((_coded(part, a, a + SPAN, codes), to.astype(np.int64), np.full(len(a), doc, np.int64), np.full(len(a), tag, np.int64), a + base, np.full(len(a), SPAN)))
                        held += 140 * len(a)
                    if held > FLUSH_BYTES:
                        yield from flush()
                        held = 0
        if rows:
            yield from flush()

    return worker(run)


def _in(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


# -- 3: enhanced suffix array of a bucket -------------------------------------


#: Left of suffixes that aren't all behind the same byte.
DIVERSE = -1


class SuffixArray:
    """Sorted suffixes of several strings, with common prefixes of neighbours.

    Only suffixes of at least ``least`` bytes whose first ``least`` bytes occur more
    than once (by hash), and not always behind the same byte, take part: others have
    no common prefix that long, or one that can always be extended to the left.
    """

    def __init__(self, strings: list[bytes], least: int):
        self.least = least
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(sizes) - sizes
        self.data = b"".join(strings)
        text = np.frombuffer(self.data + b"\0" * 8, np.uint8)
        owner = np.repeat(np.arange(len(strings)), np.maximum(0, sizes - least + 1))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, sizes - least + 1)) - np.maximum(0, sizes - least + 1), np.maximum(0, sizes - least + 1))
        pos = self.starts[owner] + at
        words = np.ndarray((len(self.data) + 1,), "<u8", text, strides=(1,)).copy()
        h = np.zeros(len(pos), np.uint64)
        for k in [*range(0, least - 7, 8), max(0, least - 8)]:
            h = (h ^ words[pos + k] if least >= 8 else h ^ text[pos]) * _C[1]
            h ^= h >> np.uint64(31)
        #: The byte to the left of each suffix, or DIVERSE if it starts its string.
        left = np.where(at > 0, text[pos - 1].astype(np.int16), DIVERSE)
        order = np.argsort(h)
        s = h[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(s)))
        keep = np.sort(order[np.repeat((size > 1) & self._diverse(left[order], first), size)])
        self.owner, self.pos, self.left = owner[keep], pos[keep], left[keep]
        self.rest = (self.starts + sizes)[self.owner] - self.pos
        self._sort(words)

    @staticmethod
    def _diverse(left: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether left bytes differ, or one is missing, in each group from these rows on."""
        low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
        return (low != high) | (low == DIVERSE)

    def _sort(self, words: np.ndarray) -> None:
        n = len(self.pos)
        if not n:
            self.lcp = np.zeros(0, np.int64)
            return
        keys, swap = [], []
        for k in range(0, int(self.rest.max()), 8):
            w = np.where(k < self.rest, words[np.minimum(self.pos + k, len(words) - 1)], 0).byteswap()
            left = np.clip(self.rest - k, 0, 8)
            shift = ((8 - left) * 8).astype(np.uint64)
            w = np.where(left == 0, np.uint64(0), (w >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)))
            keys.append(w)
        order = np.lexsort((self.owner, self.rest, *reversed(keys)))
        self.owner, self.pos, self.rest, self.left = self.owner[order], self.pos[order], self.rest[order], self.left[order]
        lcp = np.zeros(n, np.int64)
        going = np.ones(n, bool)
        going[0] = False
        for w in keys:
            w = w[order]
            x = np.zeros(n, np.uint64)
            x[1:] = w[1:] ^ w[:-1]
            zero = np.zeros(n, np.int64)
            nz = x != 0
            top = np.zeros(n, np.int64)
            top[nz] = 63 - np.frexp(x[nz].astype(np.float64))[1] + 1
            # float rounding can carry into the next power of two
            top[nz] += ((x[nz] >> np.minimum(63 - np.maximum(top[nz], 0), 63).astype(np.uint64)) == 0).astype(np.int64)
            zero[~nz], zero[nz] = 8, top[nz] // 8
            lcp += np.where(going, zero, 0)
            going &= ~nz
        lcp[1:] = np.minimum(lcp[1:], np.minimum(self.rest[1:], self.rest[:-1]))
        lcp[0] = 0
        self.lcp = lcp

    def maximal_repeats(self):
        """Each maximal repeat of at least ``least`` bytes: its length and the bounds of its suffixes.

        A stack scan visits the intervals of the common-prefix tree bottom-up. Every
        open interval carries the byte to the left of its suffixes, or DIVERSE if
        they differ or one starts its string; only diverse intervals are maximal.
        Outermost intervals that aren't diverse, or have none inside, need no scan.
        """
        if not len(self.pos):
            return
        outer = self.lcp < self.least
        first = np.flatnonzero(outer)
        end = np.append(first[1:], len(outer))
        low, high = np.minimum.reduceat(np.where(outer, np.iinfo(np.int64).max, self.lcp), first), np.maximum.reduceat(np.where(outer, 0, self.lcp), first)
        diverse = (end - first > 1) & self._diverse(self.left, first)
        flat = diverse & (low == high)
        yield from zip(high[flat].tolist(), first[flat].tolist(), end[flat].tolist())
        nested = diverse & (low != high)
        for a, b in zip(first[nested].tolist(), end[nested].tolist()):
            yield from self._scan(a, b)

    def _scan(self, start: int, end: int):
        lefts = self.left[start:end].tolist()
        stack: list[list[int]] = []  # length, first suffix, left byte
        for i, depth in enumerate([*self.lcp[start + 1 : end].tolist(), 0], start + 1):
            first, left = i - 1, lefts[i - 1 - start]
            while stack and stack[-1][0] > depth:
                length, first, own = stack.pop()
                own = own if own == left else DIVERSE
                if own == DIVERSE:
                    yield length, first, i
                left = own
            if depth >= self.least:
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == left else DIVERSE
                else:
                    stack.append([depth, first, left])


def repeat_spans(strings: list[bytes], docs: np.ndarray, least: int = SPAN):
    """Ranges that also occur in a string of a smaller document: arrays ``string, start, end``, or None."""
    sa = SuffixArray(strings, least)
    if not len(sa.pos):
        return None
    of, own, at = np.asarray(docs, np.int64)[sa.owner], sa.owner, sa.pos - sa.starts[sa.owner]
    repeats = np.array([*sa.maximal_repeats()], np.int64).reshape(-1, 3)
    # repeats nest, so their occurrences are looked at so many at a time
    share = np.cumsum(repeats[:, 2] - repeats[:, 1]) // OCCURRENCES
    found = []
    for some in np.split(repeats, np.flatnonzero(share[1:] != share[:-1]) + 1):
        length, a, b = some.T
        low = np.minimum.reduceat(np.append(of, 0), np.stack((a, b), axis=1).ravel())[::2]
        i = _spread(a, b - a)
        late = of[i] > np.repeat(low, b - a)
        i, length = i[late], np.repeat(length, b - a)[late]
        found.append((own[i], at[i], at[i] + length))
    own, a, b = (np.concatenate(x) for x in zip(*found))
    return (own, a, b) if len(own) else None


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` numbers from each first one."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _spans(batches):
    """What texts lose by each bucket: ``doc_id, tag, start, end``."""
    opened = zstandard.ZstdDecompressor()
    for _, rows in _by_bucket(batches, ("kind", "docs", "tags", "starts", "sizes", "data")):
        found = []  # arrays: doc, tag, start, end
        codes = _codes()
        held = []  # arrays: code, doc, tag, offset, bytes
        for kind, *numbers, data in rows:
            d, g, s, n = (np.frombuffer(x, np.int64) for x in numbers)
            if kind:
                found.append((d, g, s, s + n))
                continue
            data = opened.decompress(data)
            z = np.cumsum(n)
            held.append((_coded(data, z - n, z, codes), d, g, s, n))
        rows.clear()
        if held:
            code, doc, tag, at, size = (np.concatenate(x) for x in zip(*held))
            held.clear()
            strings, low = [*codes], _lowest(code, doc)
            codes.clear()
            late = doc > low
            found.append((doc[late], tag[late], at[late], at[late] + size[late]))
            first = np.empty(len(strings), np.int64)
            first[code] = low
            inner = repeat_spans(strings, first)
            if inner is not None:
                of, a, b = inner
                # a string's ranges hold for each of its places in its first document
                code, doc, tag, at = code[~late], doc[~late], tag[~late], at[~late]
                order = _order(code)
                places = np.bincount(code, minlength=len(strings))
                n = places[of]
                i = order[_spread((np.cumsum(places) - places)[of], n)]
                found.append((doc[i], tag[i], at[i] + np.repeat(a, n), at[i] + np.repeat(b, n)))
        doc, tag, a, b = (np.concatenate(x) for x in zip(*found))
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(doc, tag, a, b)], ["doc_id", "tag", "start", "end"])


def _ranges(told: pa.Table) -> dict[int, list[bytes]]:
    """What texts lose by document: for each text its tag and then starts and ends."""
    doc, tag, a, b = _merged(*(told[c].to_numpy() for c in ("doc_id", "tag", "start", "end")))
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
    packed = np.stack((a, b), axis=1)
    known: dict[int, list[bytes]] = {}
    for k, x, y in zip(doc[first].tolist(), first.tolist(), np.append(first[1:], len(doc)).tolist()):
        known.setdefault(k, []).append(tag[x : x + 1].tobytes() + packed[x:y].tobytes())
    return known


# -- 4: documents -------------------------------------------------------------


def find_spans(documents: DataFrame, n_parts: int, total: int, entries: int = BUCKET_ENTRIES, heavy: int = HEAVY) -> DataFrame:
    """Packed rows ``doc_id, tag, start, end`` of ``documents(doc_id, text, tag)``: byte ranges, which may overlap or adjoin."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "tag")
    buckets = int(max(16, total // 16 // entries + 1))
    heavy = max(heavy, total // 16 // MOST_HEAVY)
    minimisers = d.select("doc_id", "text").mapInArrow(_scan(buckets), "bucket int, known int, docs binary, ms binary, counts binary")
    asked = _dealt(minimisers, buckets, "bucket").sortWithinPartitions("bucket")
    answers = cut(asked.mapInArrow(_answers_packed(heavy, n_parts), _PACKED))
    hot = [_unpack48(bytes(r.data)) for r in answers.where("kind = 2").select("data").collect()]
    hot = np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
    wanted = answers.where("kind = 0")
    runs = meet(d, wanted, n_parts, _minimisers, _runs(buckets, hot), "bucket int, kind int, docs binary, tags binary, starts binary, sizes binary, data binary")
    spans = cut(_dealt(runs, buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_packed_known(n_parts, _spans), _PACKED))
    discard(answers)
    return spans


def cut_out(data: bytes, packed: list[bytes] | None, tag: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the removed ranges."""
    own = tag.to_bytes(8, "little", signed=True)
    spans = _merge([(a, b) for p in packed or () if p[:8] == own for a, b in np.frombuffer(p, np.int64, offset=8).reshape(-1, 2).tolist()])
    left, at = [], 0
    for a, b in spans:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), spans


def with_spans(documents: DataFrame, f, schema, entries: int = BUCKET_ENTRIES, heavy: int = HEAVY) -> DataFrame:
    """Run ``f(tag)``'s function over batches of documents with the spans found in them, by doc_id; ``tag`` names the column of tags."""
    small_batches(documents.sparkSession)
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = int(max(documents.sparkSession.sparkContext.defaultParallelism, total // PART_BYTES + 1))
    tag = unused(documents.columns, "tag")
    d = documents.withColumn(tag, F.xxhash64("text"))
    spans = find_spans(d.select("doc_id", "text", F.col(tag).alias("tag")), n_parts, total, entries, heavy)
    return meet(d, spans, n_parts, _ranges, f(tag), schema)


_KINDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _digest(tag: str):
    def run(meetings):
        for known, b in meetings:
            rows = []
            for doc, g, text in zip(b.column("doc_id").to_pylist(), b.column(tag).to_pylist(), b.column("text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, spans = cut_out(data, known.get(doc), g)
                rows.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _KINDS)], [n for n, _ in _KINDS])

    return worker(run)


def op10_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_spans(d, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _texts(names: tuple[str, ...]):
    def with_tag(tag: str):
        def run(meetings):
            for known, b in meetings:
                kept = []
                for doc, g, text in zip(b.column("doc_id").to_pylist(), b.column(tag).to_pylist(), b.column("text")):
                    t, packed = text.as_py(), known.get(doc)
                    # a range may end inside a character; what is left of one goes too
                    kept.append(t if not packed or t is None else cut_out(t.encode(), packed, g)[0].decode(errors="ignore"))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == "text" else b.column(n) for n in names], [*names])

        return worker(run)

    return with_tag


def drop_repeats(documents: DataFrame) -> DataFrame:
    """The documents, rows and columns as they came, without repeated strings in ``text``."""
    return with_spans(documents, _texts(tuple(documents.columns)), documents.schema)
