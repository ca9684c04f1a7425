"""Queries over a written tree, held against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestar import extension_queries, table_queries, tree_queries
from lodestar.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ in (tree_queries.__name__, table_queries.__name__, extension_queries.__name__) and n in ORACLES]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(TABLES):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    out = QUERIES[name](spark, TABLES)
    columns = sorted(out.columns)
    assert plain(tuple(r) for r in out.select(*columns).collect()) == plain(tables.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
