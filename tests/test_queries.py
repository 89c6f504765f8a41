"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import __spark_entry__ as entry  # noqa: E402
from nearbox.plans.registry import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def flat(x):
    if isinstance(x, float):
        return repr(x + 0.0)
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(flat, x)) + "]"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    expected = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted([flat(r[c]) for c in order] for r in got) == sorted([flat(r[c]) for c in order] for r in expected)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
