"""Every query of the library against its SQL on the smallest tables, and the entry file."""

import importlib
import math
import os

import duckdb
import pytest

from marketweave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def same(a, b):
    """Rows alike up to the last rounded digit."""
    rows = [sorted(tuple(map(plain, r)) for r in x) for x in (a, b)]
    assert len(rows[0]) == len(rows[1])
    for r, s in zip(*rows, strict=True):
        for x, y in zip(r, s, strict=True):
            assert x == y or (abs(float(x) - float(y)) <= 2e-5 * max(1.0, abs(float(x)))), (r, s)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = registry.QUERIES[name](spark, DATA), sql.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = got.collect()
    assert rows
    same([[r[c] for c in columns] for r in rows], [[r[want.columns.index(c)] for c in columns] for r in want.fetchall()])


@pytest.mark.parametrize("name", ["exact_means", "overlapping_stream", "ranged_pages"])
def test_query_equals_its_sql_in_every_digit(spark, sql, name):
    got, want = registry.QUERIES[name](spark, DATA), sql.sql(registry.ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_modules():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "marketweave")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as file:
                    assert "marketweave.llm" not in file.read()
