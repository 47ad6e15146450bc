"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import all_oracles, all_queries
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_oracles())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = all_queries()[name](spark, SF)
    cursor = duck.execute(all_oracles()[name])
    order = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    assert sorted(got.columns) == [cursor.description[i][0] for i in order]
    expected = sorted(repr(tuple(_plain(r[i]) for i in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(_plain(r[c]) for c in sorted(got.columns))) for r in got.collect()) == expected
