"""Every query against its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from verisieve.plans.catalogue import ORACLES, QUERIES


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    try:
        return round(float(v), 4) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="session")
def sql(data):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    got = QUERIES[name](spark, data)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name in ORACLES:
        cur = sql.execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(got.columns)
        want = [tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()]
        assert sorted(map(str, rows)) == sorted(map(str, want))


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
