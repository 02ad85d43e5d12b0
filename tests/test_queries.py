"""Registered queries against their SQL."""

import os

import pytest

from chronofold.plans import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for name in ("events", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_every_query_is_known_to_the_driver(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
