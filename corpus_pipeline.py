"""A training corpus from ``documents``: five stages, each one operator of ``sitefold.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``, whatever their names. :func:`run` writes each stage's result
as Parquet to the shared folder and reads it back.

Defined cases: a null text is empty to every stage and stays null; a null doc_id is
like no other document, loses nothing and stays, unless its own text is toxic or
contaminated; rows that repeat a doc_id are judged by their own text; texts of any
length are read whole; empty texts are alike, so the one of the smallest doc_id
stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm import bpe, decontaminate, repeats, simhash, toxicity
from sitefold.llm.common import shared_dir, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean_documents(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of an earlier document; ``n_chars`` follows, texts of which nothing is left go."""
    empty = unused(docs.columns, "was_empty")
    kept = repeats.drop_repeats(docs.withColumn(empty, F.expr("coalesce(text = '', false)")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.where(F.col("text").isNull() | (F.col("text") != "") | F.col(empty)).drop(empty)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark n-grams."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and of the decoded bytes."""
    return bpe.encode(docs, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("repeats", drop_repeated_strings),
    ("decontamination", drop_contaminated),
    ("tokens", encode_tokens),
]

#: SQL can't express the classifier, the fingerprints' classes and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
