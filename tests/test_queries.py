"""Every registered query of the engine against the SQL that checks it, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from multiweave.plans import queries as core

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return 0.0 if v == 0 and isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = core.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    sql = core.ORACLE[name].strip()
    assert sorted(con.sql(sql).columns) == cols
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    want = [tuple(map(plain, r)) for r in con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({sql})").fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.ORACLE.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert core.QUERIES[name](spark, D).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry_works_without_the_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['multiweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__)).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "False"]


def test_zones_of_a_larger_table_are_more_tasks(spark, tmp_path, monkeypatch):
    from multiweave.plans import domain

    monkeypatch.setattr(domain, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(domain, "ZONE_ROWS", 500, raising=False)
    n = duckdb.sql(f"select count(*) from '{D}/lineitem.parquet'").fetchall()[0][0]
    got = core.QUERIES["zone_map_skip"](spark, D).first()
    held = [duckdb.sql(f"select count(*) from '{p}'").fetchall()[0][0] for p in glob.glob(f"{tmp_path}/zones/*.parquet")]
    assert sum(held) == n and len(held) >= n // 500 and max(held) < 1500
    assert got["scanned_segments"] == 1 and got["skipped_segments"] >= len(held) - 1
