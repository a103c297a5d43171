"""Benchmark decontamination: which words of a document lie in benchmark n-grams.

DataFrame operations only. Every distinct n-gram of the benchmark goes into a
broadcast hash set under a 64-bit hash of its words. A scan hashes every window of
a document's words, as many words long as n-grams there are (ten, and fewer for
short items), probes the set, and compares the words of what it hits. The set is
broadcast only if its measured size is within ``BROADCAST_BYTES``; a larger one is
joined by shuffle on the hash: a window then sends its hash and place (salted, as a
common passage has the same hash everywhere), and the documents with hits are read
once more to compare words.

Defined cases: null or empty text has no words; an item of fewer words than
``n``, but not none, is one window; equal windows of several items count for
each; rows that repeat a doc_id are judged by their own text; a null doc_id is
an id like any other; an empty benchmark leaves every document clean; further
columns are kept by :func:`clean_documents` and :func:`summarise` (which raises an
error if one has the name of a column that it adds) and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, cut, table, unused

N = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
SALTS = 32


def words_of(text: Column) -> Column:
    """Words in order. Only the first and last part of a split can be empty."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def ngram_table(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: ``key, gram, items``; ``gram`` is the array of words, ``key`` its hash."""
    w = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))).alias("i"))
    g = w.select("item_id", F.slice("w", F.col("i"), n).alias("gram"))
    g = g.groupBy("gram").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return g.select(F.xxhash64("gram").alias("key"), "gram", "items")


def window_hashes(size: int) -> Column:
    """Hashes of all windows of ``size`` words of the array ``w``, in order."""
    starts = F.sequence(F.lit(1), F.size("w") - (size - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, size)))
    return F.when(F.size("w") >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def hits(documents: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Occurring windows: ``doc_id, h, start, len, items`` (``h``: hash of the text; start from 0)."""
    grams = cut(ngram_table(benchmark, n))
    whole = grams.agg(F.sum(F.aggregate("gram", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + F.size("items") * 24 + 64).alias("bytes"), F.collect_set(F.size("gram")).alias("sizes")).first()
    sizes = sorted(whole.sizes) or [n]  # n numbers at most
    d = documents.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    # a window of each size in turn; most benchmarks have one size
    found = None
    for size in sizes:
        at = d.select("doc_id", "h", "w", F.posexplode(window_hashes(size)).alias("start", "probe"))
        own = grams.where(F.size("gram") == size)
        if (whole.bytes or 0) <= broadcast_bytes:
            one = at.join(F.broadcast(own), (F.col("probe") == F.col("key")) & (F.slice("w", F.col("start") + 1, size) == F.col("gram")))
        else:
            salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            places = at.select("doc_id", "h", "start", "probe", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int").alias("s"))
            near = places.join(own.withColumn("salt", salt), (F.col("probe") == F.col("key")) & (F.col("s") == F.col("salt"))).select("doc_id", "h", "start", "gram", "items")
            again = d.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "w")
            # repeated rows would repeat each other's hits
            again = again.dropDuplicates(["id", "g"])
            near = near.dropDuplicates(["doc_id", "h", "start", "gram"])
            one = near.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")) & (F.slice("w", F.col("start") + 1, size) == F.col("gram")))
        one = one.select("doc_id", "h", "start", F.lit(size).alias("len"), "items")
        found = one if found is None else found.unionByName(one)
    return found


def summarise(documents: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with ``n_words, n_hit, n_items, items`` added."""
    added = {"n_words", "n_hit", "n_items", "items"} & {c.lower() for c in documents.columns}
    if added:
        raise ValueError(f"the documents have columns {sorted(added)}")
    found = hits(documents, benchmark, n, broadcast_bytes)
    # one row per word hit, counted once; partial counts on the map side
    spots = found.select("doc_id", "h", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p"), "items")
    spots = spots.select("doc_id", "h", "p", F.explode("items").alias("item"))
    per_word = spots.groupBy("doc_id", "h", "item", "p").agg(F.lit(1).alias("one"))
    per_doc = per_word.groupBy("doc_id", "h").agg(F.count_distinct("p").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    i, h, g = (unused(documents.columns, x) for x in ("hit_id", "hit_h", "hit_g"))
    base = documents.withColumns({g: F.xxhash64("text"), "n_words": F.size(words_of(F.col("text"))).cast("long")})
    hit = per_doc.select(F.col("doc_id").alias(i), F.col("h").alias(h), "n_hit", "items")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(g) == F.col(h)), "left").drop(i, h, g)
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn(
        "n_items", F.size("items").cast("long")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit and items found in every document."""
    d = summarise(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents without a benchmark window, columns and rows otherwise as they came.

    The ids found are written and counted; few are broadcast, so that texts aren't shuffled.
    """
    i, h, g = (unused(documents.columns, x) for x in ("hit_id", "hit_h", "hit_g"))
    bad = cut(hits(documents, benchmark, n, broadcast_bytes).select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct())
    bad = broadcast_if_small(bad, 80, broadcast_bytes)
    return documents.withColumn(g, F.xxhash64("text")).join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(g) == F.col(h)), "left_anti").drop(g)


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, array_to_string(w[i : i + {N - 1}], ' ') AS gram, least(len(w), {N}) AS l
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {N - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS gram
      FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
m AS (SELECT r, i, x.l, item FROM x JOIN g USING (gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""
