import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with ids from 0, over a few partitions."""

    def make(texts, ids=None, partitions=3, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, *(v[k] for v in columns.values())) for k, (i, t) in enumerate(zip(ids, texts))]
        schema = "doc_id long, text string" + "".join(f", {c} {'int' if c == 'toxic' else 'string'}" for c in columns)
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return make


@pytest.fixture
def saved(tmp_path):
    """Tables written as NAME.parquet; the folder they lie in."""

    def save(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save
