"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import sys

import pytest

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402
from tabulon import queries as engine  # noqa: E402

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_query(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    cur = duck.execute(engine.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    want = sorted((tuple(tidy(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(tidy(v) for v in r) for r in got.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    assert len(have) == len(want)
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
