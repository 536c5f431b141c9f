"""Every query of the catalogue against its SQL twin on a small scale."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__
from wattloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.isoformat() if isinstance(v, dt.datetime) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    exact = lambda r: [v if not isinstance(v, float) else round(v, 3) for v in r]
    return sorted([tuple(plain(r[k]) for k in order) for r in data], key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(exact(r)))), [names[k] for k in order]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got, columns = rows(df.columns, df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    cur = duck.execute(catalogue.ORACLES[name])
    want, names = rows([d[0] for d in cur.description], cur.fetchall())
    assert columns == names and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["device", "seg", "t_start", "t_end", "duration_min", "n", "variance"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_are_dealt_by_bucket(spark):
    plan = catalogue.active_segments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scanned = [line for line in plan.splitlines() if "Window" in line and "AS _on" not in line and "_bucket" not in line]
    assert not scanned, scanned  # windows of rows are within a bucket, windows along a series see a row for each bucket
