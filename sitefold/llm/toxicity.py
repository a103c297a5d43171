"""Toxic passages as maximum-scoring segments of token log-odds.

Fit: over a bounded sample of labelled texts, each token (a word, and a word's
first letters as ``^abcd``) gets the log-odds of standing in a toxic text against
a clean one, shrunken by a Dirichlet prior in proportion to its count in both.
Tokens whose log-odds stay positive by some standard errors make up the lexicon, whose
size follows the sample; every other word costs ``GAP``.

Score: one pass over a text's words finds all maximal-scoring segments (Ruzzo and
Tompa's linear-time algorithm, run on the lexicon's words and the gaps between
them). A segment of score S in n words has the extreme-value E = K n exp(-lambda
S), with lambda from the clean words' score distribution; what the segments are
above chance, in nats, is summed and mapped to 0..1 by logistic regression, which
is fitted on texts that the lexicon was not counted from.

Labels are read from at most ``SAMPLE`` rows, the first by hash of doc_id.

Defined cases: null or empty text has no words and gets the score of a text
without toxic passages; several labels of one document count as toxic if one is;
labels that are null are left out; repeated rows are each scored; without any
toxic or any clean label every score is the share of toxic labels (0 without
labels); further columns are kept by :func:`score_documents`, which raises an error if
one has the name of a column that it adds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, small_batches, table, unused, worker

SAMPLE, GAP = 40_000, 0.05
PREFIXES = (4, 5, 6)
#: Share of both counts that is the prior; a token's weight is its log-odds less so many standard errors.
PRIOR, ERRORS, LEAST_COUNT, LEAST_WEIGHT = 0.1, 1.4, 3, 1.0
_WORD = re.compile(r"[^\W\d_]+")
#: Characters handled at once, so that memory doesn't follow the longest text.
PART = 1 << 20


def words(text: str | None):
    """Lists of lower-case words, part by part; parts end between words."""
    text, at = text or "", 0
    while at < len(text):
        to = at + PART
        while to < len(text) and text[to].isalpha():
            to += 1
        yield _WORD.findall(text[at:to].lower())
        at = to


def features(word: str):
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield "^" + word[:n]


@dataclass
class Model:
    """What scoring needs; its size is bounded by the sample of labelled texts."""

    weights: dict[str, float] = field(default_factory=dict)
    gap: float = GAP
    lam: float = 1.0
    k: float = 0.1
    intercept: float = -20.0
    slope: float = 0.0

    def weight(self, word: str) -> float:
        """Of the word itself, or else of its longest known beginning."""
        w = self.weights
        if word in w:
            return w[word]
        for n in reversed(PREFIXES):
            if len(word) > n and "^" + word[:n] in w:
                return w["^" + word[:n]]
        return 0.0

    def segments(self, text: str | None, memo: dict | None = None) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments ``(first word, past last word, score)`` and the number of words."""
        memo = _Memo(self) if memo is None else memo
        at, spots = 0, []
        for part in words(text):
            w = np.fromiter(map(memo.__getitem__, part), np.float64, len(part))
            hit = np.flatnonzero(w)
            spots += zip((hit + at).tolist(), w[hit].tolist())
            at += len(part)
        return maximal_segments(spots, self.gap), at

    def evidence(self, segments, n: int) -> float:
        """Nats by which segments exceed what chance gives in ``n`` words."""
        chance = math.log(max(self.k * n, 1.0))
        return sum(max(0.0, self.lam * s - chance) for _, _, s in segments)

    def score(self, evidence: float) -> float:
        x = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class _Memo(dict):
    """Weights by word, for the words met; emptied when large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = self.model.weight(word)
        return value


def maximal_segments(spots: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence that is ``-gap`` but for ``spots``, in linear time."""
    kept: list[list] = []  # first, past last, sum before it, sum up to its end, kept segment to look at next
    total, last = 0.0, 0
    for at, w in spots:
        total -= gap * (at - last)
        last = at + 1
        lo, total = total, total + w
        seg = [at, at + 1, lo, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= seg[3]:
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:]
        kept.append([*seg, j])
    return [(a, b, hi - lo) for a, b, lo, hi, _ in kept]


@worker
def _counts(batches):
    """Documents with each token, by label; flushed before the counters grow large."""
    tally = (Counter(), Counter())

    def out():
        tokens = [*{*tally[0], *tally[1]}]
        rows = pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *(pa.array([c[t] for t in tokens], pa.int64()) for c in tally)], ["token", "n0", "n1"])
        for c in tally:
            c.clear()
        return rows

    for b in batches:
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            distinct = {w for part in words(text.as_py()) for w in part}
            tally[toxic].update({f for w in distinct for f in features(w)})
            if len(tally[0]) + len(tally[1]) > 300_000:
                yield out()
    if tally[0] or tally[1]:
        yield out()


def _evidence(model: Model):
    def run(batches):
        memo = _Memo(model)
        for b in batches:
            found = [model.segments(x.as_py(), memo) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array([model.evidence(*x) for x in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), pa.array([len(s) for s, _ in found], pa.int64())],
                ["toxic", "evidence", "n_words", "n_segments"],
            )

    return worker(run)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled texts that are not held out."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded: a few hundred KB
    d = documents.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("_id"))
    # one row per distinct text, or copies would make their words look significant
    d = cut(d.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    learn, check = d.where(fold != 0).select("text", "toxic"), d.where(fold == 0).select("text", "toxic")
    n = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(intercept=40.0 if share == 1 else -40.0 if not share else math.log(share / (1 - share)))
    counts = learn.mapInArrow(_counts, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    a = PRIOR * (F.col("n0") + F.col("n1"))
    odds = lambda y, m: F.log((y + a) / (F.greatest(m + PRIOR * (n0 + n1) - y - a, F.lit(0.5))))
    scored = counts.where(F.col("n1") >= LEAST_COUNT).withColumn("delta", odds(F.col("n1"), n1) - odds(F.col("n0"), n0))
    scored = scored.withColumn("w", F.col("delta") - ERRORS * F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a)))
    top = scored.where(F.col("w") >= LEAST_WEIGHT).orderBy(F.col("w").desc(), "token").collect()  # tokens of the bounded sample
    model = Model(weights={r.token: r.w for r in top})
    if not top:
        return model
    # how often the lexicon's words stand in clean texts it was not counted from, half a time more than seen
    clean = check.where("toxic = 0").mapInArrow(_evidence(model), "toxic int, evidence double, n_words long, n_segments long").agg(F.sum("n_words").alias("w"), F.sum("n_segments").alias("s")).first()
    n_words, n_seg = clean.w or 1, clean.s or 0
    p, mean = (n_seg + 0.5) / (n_words + 1), float(np.mean([*model.weights.values()]))
    model.lam = _root(p, mean, model.gap)
    model.k = min(1.0, (n_seg + 0.5) / (n_words * math.exp(-model.lam * mean) + 1e-12)) if n_seg else 0.1
    rows = check.mapInArrow(_evidence(model), "toxic int, evidence double, n_words long, n_segments long").select("toxic", "evidence").toPandas()  # sample / 4 rows at most
    model.intercept, model.slope = _logistic(np.log1p(rows.evidence.to_numpy()), rows.toxic.to_numpy())
    discard(d)
    return model


def _root(p: float, up: float, down: float) -> float:
    """lambda > 0 with p exp(lambda up) + (1 - p) exp(-lambda down) = 1."""
    lo, hi = 1e-9, 200 / up
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p * math.exp(mid * up) + (1 - p) * math.exp(-mid * down) < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope, by Newton's method with a small ridge on the slope."""
    if not len(x):
        return -2.0, 2.0
    a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0, ridge]) * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag([1e-6, ridge])
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _score(model: Model, keep: tuple[str, ...], added: tuple[str, ...]):
    def run(batches):
        memo = _Memo(model)
        for b in batches:
            found = [model.segments(x.as_py(), memo) for x in b.column("text")]
            scores = [model.score(model.evidence(*x)) for x in found]
            cols = [b.column(c) for c in keep] + [pa.array(scores, pa.float64())]
            if len(added) > 1:
                cols.append(pa.array([[{"first": i, "past": j, "score": s} for i, j, s in x] for x, _ in found], pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *added])

    return worker(run)


def score_documents(documents: DataFrame, model: Model, passages: bool = False, score: str = "tox_score") -> DataFrame:
    """The documents with the column ``score`` and, if asked for, ``passages`` (word positions and scores)."""
    added = (score, "passages") if passages else (score,)
    clash = {c.lower() for c in documents.columns} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"the documents have columns {sorted(clash)}")
    small_batches(documents.sparkSession)
    extra = [T.StructField(score, T.DoubleType())]
    if passages:
        extra.append(T.StructField("passages", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType()), T.StructField("score", T.DoubleType())]))))
    return documents.mapInArrow(_score(model, tuple(documents.columns), added), T.StructType([*documents.schema.fields, *extra]))


def clean_documents(documents: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The documents that score less than ``below``, columns and rows otherwise as they came."""
    score = unused(documents.columns, "tox_score")
    return score_documents(documents, model, score=score).where(F.col(score) < below).drop(score)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
