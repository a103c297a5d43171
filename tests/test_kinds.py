"""Sums over haplotypes, and over their pairs, go by kinds where a source knows of any."""

import tracemalloc

import duckdb
import numpy as np
import pytest

import verify
from sitefold.operators import panel, windows
from sitefold.operators.resampling import block_jackknife
from sitefold.plans import fixture, registry

#: Queries that make no alleles by haplotype at all, not even a piece at a time.
BY_KINDS = """average_patterson_d divergence_of_two diversity_by_population fst_weir_cockerham frequency_extremes heterozygosity heterozygosity_sums
joint_sfs joint_sfs_folded missing_summary moving_patterson_f3 windowed_divergence
distance_based_stats ehh_decay haplotype_distances identity_by_state genetic_relationship""".split()


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """60 individuals at 240 sites, and the same for DuckDB."""
    d = tmp_path_factory.mktemp("kinds")
    for t in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    spark.range(60).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey").write.parquet(f"{d}/supplier.parquet")
    spark.range(240).selectExpr("id AS p_partkey", "cast(1 + id % 50 AS int) AS p_size").write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return str(d), con


@pytest.fixture
def no_alleles(monkeypatch):
    """A task that makes alleles by haplotype fails, in a piece or as a table."""

    def refused(*_):
        raise AssertionError("alleles by haplotype")

    monkeypatch.setattr(panel.Panel, "matrix", lambda *_: refused)
    monkeypatch.setattr(panel, "_alleles", lambda source, width: source.rows.mapInArrow(refused, panel.VARIANTS))


@pytest.mark.parametrize("name", BY_KINDS)
def test_no_alleles_by_haplotype_are_made_and_sql_agrees(name, spark, tables, no_alleles):
    d, con = tables
    df = registry.QUERIES[name](spark, d)
    cur = con.execute(registry.SQL[name])
    assert not verify.compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("complete", [False, True])
def test_counts_by_kinds_are_those_of_haplotypes(complete, spark, sf_dir):
    p = fixture.panel(spark, sf_dir, complete=complete)
    plain = p.with_variants(p.variants)
    assert p.kinds() is not None and plain.kinds() is None
    # haplotypes without their partner, in another order, and one twice
    for q in ("EUROPE", None, [5, 4, 9, 0, 1, 11], [2, 2, 3]):
        a, b = (sorted(x.site_counts(q, diploid=True).collect()) for x in (p, plain))
        assert a == b
        a, b = (sorted(x.population(q).count_missing(0).collect()) for x in (p, plain))
        assert a == b
        assert (p.population(q).count_called(1) == plain.population(q).count_called(1)).all()
    assert p.count_missing() == plain.count_missing()


def test_the_jackknife_takes_no_square_of_the_blocks():
    x, y = np.random.default_rng(1).random((2, 3000))
    tracemalloc.start()
    _, se, left_out = block_jackknife((x, y), lambda a, b: a.sum() / b.sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(left_out, (x.sum() - x) / (y.sum() - y), rtol=1e-12) and se > 0
    assert peak < 1 << 20  # 9 MB before; of 24,000 blocks 576 MB


def test_windows_of_two_populations_take_no_null_variances(spark, tables, monkeypatch):
    def refused(*_):
        raise AssertionError("null variances")

    monkeypatch.setattr(windows, "variance_coefficients", refused)
    assert registry.QUERIES["windowed_divergence"](spark, tables[0]).collect()
