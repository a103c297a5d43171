"""Queries and their SQL read every site."""

import re

import duckdb
import pytest

import verify
from sitefold.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that would be dear on large tables, and so might be tempted to read a part.
DEAR = """distance_based_stats dosage_counts ehh_decay genetic_relationship haplotype_statistics heterozygosity identity_by_state ihs ld_binned_sums
ld_by_distance_two_populations ld_pairs ld_sums_by_recombination moving_garud_h nsl pairwise_diffs_haploid rogers_huff_r_squared sigma_d2_of_dosages
windowed_haplotype_statistics windowed_r_squared xpehh xpnsl zns zns_sigma_d2_and_omega""".split()


def test_no_sql_is_restricted_to_some_sites():
    assert not [k for k, v in SQL.items() if re.search(r"p_partkey\s*[<>]\s*\d+", v)]


@pytest.mark.parametrize("name", DEAR)
def test_no_site_is_filtered(name, spark, sf_dir, monkeypatch):
    """Also where the smallest tables have no site beyond the filter."""
    given, real = [], registry.panel
    monkeypatch.setattr(registry, "panel", lambda *a, **k: given.append((a[2:], k.get("where"))) or real(*a, **k))
    QUERIES[name](spark, sf_dir)
    assert given and all(g == ((), None) for g in given)


def test_the_mask_reaches_the_last_site(spark, sf_dir, tmp_path):
    """Beyond position 20,000,000; the SQL says the same."""
    for t in ("supplier", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    parts = [(k, 1) for k in (1, 3, 205_000, 205_001, 205_003)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = sorted(QUERIES["windowed_pi_masked"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for t in ("part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(SQL["windowed_pi_masked"])
    assert not verify.compare(["window_id", "pi", "bases"], [(r.window_id, r.pi, r.bases) for r in rows], [c[0] for c in cur.description], cur.fetchall())
    assert len(rows) > 1000 and all(r.bases > 0 and r.pi is not None for r in rows) and rows[-1].pi > 0
