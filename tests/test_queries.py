"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

import verify
from sitefold.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, tables):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in SQL:
        cur = tables.execute(SQL[name])
        assert not verify.compare(df.columns, got, [c[0] for c in cur.description], cur.fetchall())


def test_plans_prune_and_do_not_join_everything(spark, sf_dir):
    """Per-site counts take no shuffle; a windowed aggregate takes one and its partial sums."""
    from sitefold.plans.fixture import panel

    plan = panel(spark, sf_dir).site_counts("EUROPE")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the fixture spreads its one small file
    plan = QUERIES["windowed_diversity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entry_works_without_the_optional_parts(tmp_path):
    """In a copy of the repository without the subpackage, with and without the pipeline's file."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(verify.__file__).resolve().parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'windowed_diversity' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("corpus_pipeline.py", None):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, check=True)
        if name and (tmp_path / "copy" / name).exists():
            (tmp_path / "copy" / name).unlink()
