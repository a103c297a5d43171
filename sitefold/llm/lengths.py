"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Documents are aggregated by token count; everything else is computed on the
distinct lengths. Suffix sums go over two levels (blocks of lengths, then lengths
within a block), so no window spans the whole table.

Defined cases: null or empty text has length 0 and counts as a document; repeated
rows count each time; an empty table gives an empty histogram; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import token_counts
from .common import cut, table

BLOCK = 512


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` from one row per document."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length as a context limit: documents and tokens at, up to and beyond it.

    ``limit, n_docs, docs_over, docs_upto, tokens_upto, truncated_tokens, total_tokens, share_upto``;
    ``truncated_tokens`` is the sum over documents of min(length, limit).
    """
    hist = cut(hist).withColumn("b", (F.col("n_tokens") / block).cast("long"))
    whole = hist.agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")).first()
    docs, tokens = whole.d or 0, whole.t or 0
    # a row per block: the number of blocks follows the longest document, not the rows
    blocks = hist.groupBy("b").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("b", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    within = Window.partitionBy("b").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = hist.withColumn("d_in", F.coalesce(F.sum("n_docs").over(within), F.lit(0))).withColumn("t_in", F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0)))
    o = own.join(blocks, "b").withColumn("over", F.col("d_after") + F.col("d_in")).withColumn("t_over", F.col("t_after") + F.col("t_in"))
    return o.select(
        F.col("n_tokens").alias("limit"),
        "n_docs",
        F.col("over").alias("docs_over"),
        (F.lit(docs) - F.col("over")).alias("docs_upto"),
        (F.lit(tokens) - F.col("t_over")).alias("tokens_upto"),
        (F.lit(tokens) - F.col("t_over") + F.col("over") * F.col("n_tokens")).alias("truncated_tokens"),
        F.lit(tokens).cast("long").alias("total_tokens"),
        ((F.lit(docs) - F.col("over")) / F.lit(max(docs, 1))).alias("share_upto"),
    )


def quantile(table_of_limits: DataFrame, q: float) -> int | None:
    """The smallest length that a share ``q`` of the documents doesn't exceed."""
    return table_of_limits.where(F.col("share_upto") >= q).agg(F.min("limit")).first()[0]


def truncated_total(table_of_limits: DataFrame, limit: int) -> int:
    """Tokens left if each document is cut at ``limit``, which need not occur as a length.

    Documents up to the next smaller length count in full, all others ``limit`` each.
    """
    r = table_of_limits.where(F.col("limit") <= limit).agg(F.max_by(F.struct("tokens_upto", "docs_over"), "limit").alias("r")).first().r
    if r is not None:
        return r.tokens_upto + r.docs_over * limit
    return (table_of_limits.agg(F.max("docs_upto")).first()[0] or 0) * limit


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of limits over all documents."""
    return limits(histogram(token_counts(table(spark, sf_dir, "documents"))))
