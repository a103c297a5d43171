"""Byte-level BPE encoding and decoding.

Texts of a batch become one array of codepoints. A table gives each codepoint's
class; each class is a function from state to state, and the states after every
codepoint come from a blocked scan: functions of all blocks are composed in
lockstep, block functions are combined by doubling (composition is associative),
and one more lockstep pass fills in the states. Piece boundaries follow from
states and neighbours. No regular expression runs over a text.

Pieces are slices of the UTF-8 bytes and go through a cache that maps a piece to
its ids; pieces not yet known are merged together, one pair per piece and round,
in numpy. Token offsets in the UTF-8 text come with the ids where asked for, and
decoding puts each token's bytes at its offset.

The transitions are those of one published pattern, ``PATTERN``; another is refused.
Classes of codepoints come from the tokenizer library's own Unicode tables, once on
the driver, and travel to the tasks as data.

Memory: texts are handled in chunks of about ``CHUNK`` codepoints. A longer text
is cut in front of white space that follows something else, which always is a
boundary. The cache holds ``CACHE`` pieces and is emptied when full.

Defined cases: null text encodes like the empty one, to no ids; strings of
special tokens are ordinary text; repeated rows each get a row; null doc_id is
kept; an empty table gives an empty result; further columns are ignored, or kept
by :func:`encode_rows`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, worker

CHUNK, CACHE, BLOCK = 1 << 19, 300_000, 64
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The pattern that the classes and transitions below stand for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# classes of codepoints; END separates texts
END, ONE, E_, RV, L_, LETTER, NUMBER, OTHER, APOS, SPACE, WHITE = range(11)
# states after a codepoint
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, AT_APOS, APOS_RV, APOS_L = range(9)
STATES = 9


def _transitions() -> np.ndarray:
    """``t[class, state]``: the state after reading that class."""
    t = np.zeros((11, STATES), np.uint8)
    for c in (ONE, E_, RV, L_, LETTER):
        t[c] = IN_LETTERS
    t[NUMBER], t[OTHER], t[SPACE], t[WHITE] = IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE
    # an apostrophe starts a piece unless it goes on with others or follows a space
    t[APOS] = AT_APOS
    t[APOS, [IN_OTHER, AFTER_SPACE, AT_APOS]] = IN_OTHER
    t[ONE, AT_APOS] = FRESH  # 's 't 'm 'd
    t[RV, AT_APOS], t[L_, AT_APOS] = APOS_RV, APOS_L
    t[E_, APOS_RV] = t[L_, APOS_L] = FRESH  # 're 've 'll
    return t


TABLE = _transitions()


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, with letters and numbers as the tokenizer's own Unicode tables have them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4")
    everything = points.tobytes().decode("utf-32-le")

    def matching(pattern: str) -> np.ndarray:
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything))
        return np.frombuffer(found.decode().encode("utf-32-le"), "<u4")

    out = np.full(0x110000, OTHER, np.uint8)
    out[matching(r"\p{L}")], out[matching(r"\p{N}")], out[matching(r"\s")] = LETTER, NUMBER, WHITE
    for text, kind in (("stmd", ONE), ("e", E_), ("rv", RV), ("l", L_), ("'", APOS), (" ", SPACE)):
        out[[ord(c) for c in text]] = kind
    return out


def packed_classes() -> bytes:
    """:func:`codepoint_classes`, to be sent to tasks."""
    return zlib.compress(codepoint_classes().tobytes(), 9)


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def scan(cls: np.ndarray) -> np.ndarray:
    """The state after each class, from FRESH."""
    n = len(cls)
    m = -(-n // BLOCK)
    padded = np.zeros(m * BLOCK, np.uint8)
    padded[:n] = cls
    by_step = np.ascontiguousarray(padded.reshape(m, BLOCK).T)
    flat = np.zeros((11, 16), np.uint8)
    flat[:, :STATES] = TABLE
    flat = flat.ravel()
    rows = by_step.astype(np.intp) << 4
    f = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], m, 1)
    for t in range(BLOCK):
        f = flat[rows[t] + f]
    # f[:, j] is block j's function; an inclusive scan by doubling
    step = 1
    while step < m:
        f[:, step:] = np.take_along_axis(f[:, step:], f[:, :-step].astype(np.intp), 0) if step < m else f[:, step:]
        step *= 2
    now = np.concatenate((np.zeros(1, np.uint8), f[FRESH, :-1]))
    out = np.empty((BLOCK, m), np.uint8)
    for t in range(BLOCK):
        now = out[t] = flat[rows[t] + now]
    return out.T.reshape(-1)[:n]


def boundaries(cls: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each codepoint; ``END`` entries start one of their own."""
    n = len(cls)
    st = scan(cls)
    prev = np.concatenate(([FRESH], st[:-1]))
    nxt = np.concatenate((cls[1:], [END]))
    after = np.concatenate((st[1:], [FRESH]))
    letter, white = (cls >= ONE) & (cls <= LETTER), cls >= SPACE
    other = (cls == OTHER) | (cls == APOS)
    b = np.ones(n, bool)
    in_letters = (prev == IN_LETTERS) | (prev == APOS_RV) | (prev == APOS_L)
    b[in_letters & letter] = False
    b[(prev == IN_NUMBERS) & (cls == NUMBER)] = False
    b[((prev == IN_OTHER) | (prev == AT_APOS)) & other] = False
    b[(prev == AT_APOS) & (st == FRESH) & letter] = False
    b[((st == APOS_RV) | (st == APOS_L)) & (after == FRESH) & (nxt != END)] = False
    b[(prev == AFTER_SPACE) & ~white] = False
    # white space goes on, but for the last before something else
    last = white & ~((nxt >= SPACE) | (nxt == END))
    b[((prev == AFTER_SPACE) | (prev == AFTER_WHITE)) & white & ~last] = False
    b[cls == END] = True
    b[1:][cls[:-1] == END] = True
    return b


class Codec:
    """Encoder and decoder for one rank file of the tiktoken kind."""

    def __init__(self, path: str, classes: bytes | None = None):
        self._classes = codepoint_classes() if classes is None else _unpacked(classes)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.vocabulary = [b""] * self.size
        for word, rank in ranks.items():
            self.vocabulary[rank] = word
        self.lengths = np.array([len(w) for w in self.vocabulary], np.int64)
        self._all = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        self._start = np.cumsum(self.lengths) - self.lengths
        pairs = {}
        for word, rank in ranks.items():
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        self._pairs = pairs
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._cache: dict[bytes, bytes] = {}

    # -- merging --------------------------------------------------------------

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], self.size)

    def _merge_equal(self, words: list[bytes], n: int) -> list[bytes]:
        """Words of ``n`` bytes each: in every round each word's first pair of lowest rank merges."""
        ids = self._bytes[np.frombuffer(b"".join(words), np.uint8)].reshape(-1, n)
        live = np.arange(len(ids))
        out: list[bytes] = [b""] * len(ids)
        width = n
        while True:
            rank = self._lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(ids), 1), self.size)
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            done = best == self.size
            for k, row in zip(live[done].tolist(), ids[done].astype("<u4")):
                out[k] = row.tobytes()
            if done.all():
                return out
            ids, at, best, live = ids[~done], at[~done], best[~done], live[~done]
            # close the gap: what is right of the pair moves one to the left
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[np.arange(len(ids)), at] = best
            width -= 1

    def _merge_long(self, word: bytes) -> bytes:
        """One long piece, with a heap of pairs: n log n."""
        ids = self._bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        get, size = self._pairs.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (x := get(r * size + ids[right[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[right[i]]))
            if left[i] >= 0 and (x := get(ids[left[i]] * size + r)) is not None:
                heapq.heappush(heap, (x, left[i], ids[left[i]], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Each distinct word's ids, little-endian."""
        out, by_length = {}, {}
        for w in words:
            whole = self.ranks.get(w)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
            else:
                by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            if n > 48:
                out.update((w, self._merge_long(w)) for w in group)
            else:
                for k in range(0, len(group), 20_000):
                    out.update(zip(group[k : k + 20_000], self._merge_equal(group[k : k + 20_000], n)))
        return out

    # -- texts ----------------------------------------------------------------

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The pieces of each text, as bytes."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cls = self._classes[points]
        cls[ends] = END
        b = boundaries(cls)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(width)))
        raw = "\0".join([*texts, ""]).encode()
        starts = np.flatnonzero(b)
        stops = np.append(starts[1:], len(points))
        cuts = np.searchsorted(starts, ends)
        s, e = at[starts].tolist(), at[stops].tolist()
        lo, out = 0, []
        for hi in cuts.tolist():
            out.append([raw[x:y] for x, y in zip(s[lo:hi], e[lo:hi])])
            lo = hi + 1
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            if len(text) > CHUNK:
                out += self._encode(group)
                group, size = [], 0
                out.append(b"".join(x for part in parts_of(text) for x in self._encode([part])))
                continue
            group.append(text)
            size += len(text)
            if size >= CHUNK:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        lists = self.pieces(texts)
        cache = self._cache
        new = set().union(*lists).difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set().union(*lists)
        cache.update(self.merge([*new]))
        return [b"".join(map(cache.__getitem__, x)) for x in lists]

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset at which each token starts, and the end of the last."""
        return np.concatenate(([0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])))

    def decode(self, ids: bytes, offsets: np.ndarray | None = None) -> bytes:
        """The text's bytes: each token's at its offset."""
        tokens = np.frombuffer(ids, "<u4")
        at = self.offsets(ids) if offsets is None else offsets
        out = []
        for k in range(0, len(tokens), 1 << 16):  # in pieces, so that memory doesn't follow the longest text
            t = tokens[k : k + (1 << 16)]
            first, here = at[k : k + len(t)], np.arange(at[k], at[k + len(t)])
            out.append(self._all[here + np.repeat(self._start[t] - first, self.lengths[t])].tobytes())
        return b"".join(out)


def parts_of(text: str, size: int = CHUNK):
    """Parts of a long text, cut in front of white space that follows something else."""
    at = 0
    while len(text) - at > size:
        k = at + size
        while k < len(text) and not (text[k].isspace() and not text[k - 1].isspace()):
            k += 1
        # str.isspace knows a few controls that the pattern's white space lacks
        while k < len(text) and not (text[k] in " \n\t\r" and not text[k - 1].isspace()):
            k += 1
        yield text[at:k]
        at = k
    yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str, classes: bytes) -> Codec:
    return Codec(path, classes)


def default_path() -> str:
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizer has another pattern than this module")
    return public_tokenizers.path(VOCABULARY)


def encode_rows(path: str, keep: tuple[str, ...], decode: bool = True, ids: bool = False, offsets: bool = False):
    """For ``mapInArrow``: the columns ``keep``, then lengths, digests, ids and offsets as asked for."""
    classes = packed_classes()

    def run(batches):
        coder = codec(path, classes)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [x or "" for x in part.column("text").to_pylist()]
                encoded = coder.encode_batch(texts)
                cols = [part.column(c) for c in keep] + [pa.array([len(x) // 4 for x in encoded], pa.int64())]
                names = [*keep, "n_tokens"]
                at = [coder.offsets(x) for x in encoded] if decode or offsets else []
                if decode:
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in encoded]))
                    cols.append(pa.array([hashlib.sha256(coder.decode(x, y)).hexdigest() for x, y in zip(encoded, at)]))
                    names += ["ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array(encoded, pa.binary()))
                    names.append("ids")
                if offsets:
                    cols.append(pa.array([x.astype("<i8").tobytes() for x in at], pa.binary()))
                    names.append("offsets")
                yield pa.RecordBatch.from_arrays(cols, names)

    return worker(run)


def encode(documents: DataFrame, path: str | None = None, ids: bool = False, offsets: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (little-endian unsigned 32-bit)
    and ``offsets`` (little-endian 64-bit: the byte at which each token starts, and the end)."""
    small_batches(documents.sparkSession)
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids + ", offsets binary" * offsets
    return d.mapInArrow(encode_rows(path or default_path(), ("doc_id",), ids=ids, offsets=offsets), schema)


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``n_tokens`` of each document."""
    return documents.select("text").mapInArrow(encode_rows(path or default_path(), (), decode=False), "n_tokens long")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode(table(spark, sf_dir, "documents"))
