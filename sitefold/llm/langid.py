"""Language identification by rank-order profiles of n-grams.

A profile is the list of the most frequent letter n-grams (one to three letters,
words padded with a mark) in order of frequency. A document goes to the language
with the least out-of-place distance: the sum over the document's n-grams of how
far their rank is from the profile's, or the profile's length where they are absent.

N-grams are 63-bit integers (21 bits a codepoint; the mark between words is a number
beyond all codepoints, so n-grams of different lengths differ) and are counted by
sorting, a long text piece by piece, cut at white space.
Profiles are fitted on at most ``PER_LANGUAGE`` texts of each language, the first
by hash of doc_id, from documents that are not held out.

Defined cases: a text that is null or has no letters is ``und`` with score 0;
ties of distance go to the first language by name, ties of frequency to the
smaller n-gram; null ``lang`` is never learned; repeated rows are each judged;
without any profile every document is ``und``; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, worker

TOP, PER_LANGUAGE = 400, 5000
#: Codepoints counted at once, to the next white space; counts of parts are added up.
PART = 1 << 20
#: Stands between words. Beyond all codepoints, and 21 bits like them.
MARK = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0xD800)] + [False] * 0x800 + [chr(c).isalpha() for c in range(0xE000, 0x110000)])


def _grams(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of letters and marks; none is marks alone or has one in the middle."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4").astype(np.int64)
    c[~_letters()[c]] = MARK
    c = c[(c != MARK) | np.concatenate(([True], c[:-1] != MARK))]
    two, three = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    three = three[c[1:-1] != MARK]
    return np.concatenate((c[c != MARK], two, three))


def parts(text: str):
    """A text in parts that end at white space, so that no word is cut."""
    at = 0
    while at < len(text):
        to = at + PART
        while to < len(text) and not text[to].isspace():
            to += 1
        yield text[at:to]
        at = to


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and their counts."""
    if len(text) <= PART:
        return np.unique(_grams(text), return_counts=True)
    keys, counts = zip(*(np.unique(_grams(t), return_counts=True) for t in parts(text)))
    return _add(np.concatenate(keys), np.concatenate(counts))


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, code = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(code, counts).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


@worker
def _profile_counts(batches):
    held: dict[str, list] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            k, n = _add(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            part = count_grams(text.as_py() or "")
            if len(part[0]):
                held.setdefault(lang, []).append(part)
                size += len(part[0])
            if size > 2_000_000:
                yield from out()
                size = 0
    yield from out()


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(documents: DataFrame, top: int = TOP, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles by language: n-grams in order of frequency."""
    usable = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", "lang").distinct().withColumn("i", F.row_number().over(first)).where(F.col("i") <= per_language)
    ids = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")))
    sample = usable.join(ids, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")
    counts = sample.mapInArrow(_profile_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).collect()  # top rows a language
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        found.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Judge:
    """Profiles, ready for look-ups."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self.grams = np.unique(np.concatenate([*profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for k, name in enumerate(self.names):
            p = profiles[name]
            self.ranks[k, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = count_grams(text or "")
        if not len(keys) or not self.names:
            return "und", 0.0
        own = ranked(keys, counts, self.top)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(out.argmin())
        return self.names[best], 1.0 - float(out[best]) / (self.top * len(own))


def _judge(profiles: dict[str, np.ndarray], top: int):
    def run(batches):
        judge = Judge(profiles, top)
        for b in batches:
            found = [judge(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return worker(run)


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """``doc_id, lang_pred, score`` of each document, from its text alone."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_judge(profiles, top), "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
