"""Queries over the tables against their SQL, on the smallest tables."""

import ast
import inspect
from collections import Counter

import pytest

import __spark_entry__ as entry
from lectern.plans import number_queries, table_queries, text_queries, voice_queries
from lectern.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def by_sql(name, folder=SF, tables=TABLES):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for x in tables:
        db.execute(f"CREATE VIEW {x} AS SELECT * FROM '{folder}/{x}.parquet'")
    found = db.execute(entry.oracle_sql()[name])
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["clear_cache", "delete_entries", "evict_all", "evict_to_size", "newest_first", "regenerate", "regenerate_errors", "startup_cleanup"])
def test_histories_like_their_sql(spark, name):
    columns, want = by_sql(name)
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("module", [number_queries, table_queries, text_queries, voice_queries])
def test_no_function_is_defined_twice(module):
    names = Counter(x.name for x in ast.parse(inspect.getsource(module)).body if isinstance(x, ast.FunctionDef))
    assert [x for x, n in names.items() if n > 1] == []
