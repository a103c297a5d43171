"""Alleles are made in the tasks that use them, a bounded number at a time."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import verify
from sitefold.functions import popmath
from sitefold.operators import panel
from sitefold.plans import fixture, registry

#: Queries that make no table of alleles.
WITHOUT_A_TABLE = """frequency_extremes frequency_spectrum diplotypes joint_spectra_scaled joint_sfs ld_binned_sums""".split()
#: Queries on a cohort of which no site is complete.
AGAINST_SQL = """sfs_complete_sites site_filters joint_spectra_scaled""".split()


@pytest.fixture
def no_table(monkeypatch):
    """Whoever reads a table of made alleles fails."""

    def refused(source, width):
        def run(batches):
            raise AssertionError("a table of alleles")

        return source.rows.mapInArrow(run, panel.VARIANTS)

    monkeypatch.setattr(panel, "_alleles", refused)


@pytest.mark.parametrize("name", WITHOUT_A_TABLE)
def test_no_table_of_alleles_is_made(name, spark, sf_dir, no_table):
    assert registry.QUERIES[name](spark, sf_dir).collect()


def test_memory_follows_the_piece_and_not_the_batch(spark, sf_dir, tmp_path):
    """2,000 sites of 6,000 haplotypes in one batch: 12 MB of alleles and 96 MB of products, which were all made at once before."""
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    p = fixture.panel(spark, str(tmp_path))
    key, made, tracing = np.arange(2000) * 601, [], []
    batch = pa.RecordBatch.from_arrays([pa.array(key)], ["p_partkey"])
    matrix = p.matrix()
    tracemalloc.start()
    for b, m in panel.pieces([batch], matrix, p.num_haplotypes):
        assert m.size <= panel.PIECE
        made.append((panel.tally(m >= 0), panel.tally(m > 0)))
        tracing.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert len(made) > 1 and max(tracing) < 8 * panel.PIECE
    s, h = np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000)
    nation = spark.read.parquet(f"{tmp_path}/nation.parquet")
    region = {r.s_suppkey: r.n_regionkey for r in spark.read.parquet(f"{tmp_path}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).collect()}
    reg = np.array([region[i] for i in s])
    at = 0
    for n, d in made:
        k = key[at : at + len(n), None]
        base = k * 7919 + s * 104729 + h * 15485863
        a = (base + (k % 13) * (s % 7) * 31 + reg * k) % 97 < k * k % 89
        assert (n == (base % 23 != 0).sum(axis=1)).all() and (d == (a & (base % 23 != 0)).sum(axis=1)).all()
        at += len(n)
    assert at == len(key)


@pytest.fixture(scope="module")
def incomplete(spark, sf_dir, tmp_path_factory):
    """200 individuals at 60 sites: no site is called in all haplotypes of a population."""
    d = tmp_path_factory.mktemp("incomplete")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    spark.range(200).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(60).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size").write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_large_cohorts_agree_with_sql(name, spark, incomplete):
    d, con = incomplete
    df = registry.QUERIES[name](spark, d)
    cur = con.execute(registry.SQL[name])
    assert not verify.compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


def test_null_variances_of_large_cohorts_take_no_square_matrix():
    u = np.random.default_rng(1).random(1499)
    assert np.isclose(popmath._quadratic(u, 1500), u @ popmath.fu_covariance(1500) @ u, rtol=1e-12)
    tracemalloc.start()
    popmath.variance_coefficients("pi", "watterson", 3000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # the matrix and its parts took 400 MB
