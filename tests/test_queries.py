"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from lumenaudit.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return str(x) if not isinstance(x, (int, str, bool, type(None))) else x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_value(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    got = df.collect()
    assert got
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, got) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize(("name", "few"), [("d2_leakage_examples", 2), ("d2_leakage_report", 0), ("j5_near_pairs", 0)])
def test_hashes_are_not_broadcast(spark, sf, capsys, name, few):
    """Rows of near_pairs are merged, however few the planner takes them for; few: joins with what a limit has cut."""
    registry.queries()[name](spark, sf).explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") == few
