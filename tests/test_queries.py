"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from pagewright.plans import registry

#: Those whose DuckDB side or many jobs take long run in the driver's own check only.
SLOW = {"upkeep_links", "upkeep_compacted", "tree_digest_dirs", "stream_state"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.6f}"
    return str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    expected = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())
