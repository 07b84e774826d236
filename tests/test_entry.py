"""Every query with SQL equals it on the small tables; the entry module works without the llm parts."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from roundsmith import queries

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(rows):
    return Counter(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert norm(df.select(cols).collect()) == norm(duck.sql(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall())
    assert sorted(duck.sql(queries.ORACLES[name]).columns) == cols


def test_entry_module(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_module_without_the_llm_parts(tmp_path):
    for p in ("__spark_entry__.py", "roundsmith"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "roundsmith" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'round_summary' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
