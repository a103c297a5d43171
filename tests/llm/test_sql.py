import duckdb
import pytest

import verify
from sitefold.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.queries()[name](spark, sf_dir)
    cur = con.execute(SQL[name])
    assert not verify.compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries()])
def test_empty_tables(name, spark, saved, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false") for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")}
    got = registry.queries()[name](spark, saved(**tables)).collect()
    assert len(got) == (1 if name == "op1_chat_format" else 0)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "repeats", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes, name
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert 0 < len(out) < docs.count() and (out.ids.map(len) == 4 * out.n_tokens).all()
