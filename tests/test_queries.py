"""Every registered query with SQL gives the same rows as DuckDB, on the tables that the driver compares on."""

import datetime
import decimal

import duckdb
import pytest

from docquill import plans

SF = "/root/testdata/sf0.01"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_queries_without_sql_are_held_otherwise():
    from tests import test_brute

    names = set(plans.queries()) - set(plans.oracles())
    assert names == {"ann_index", "bbox_dedup", "chunk_documents", "embed_chunks", "kmeans", "rate_limit", "recursive_split"}
    assert all(any(k.startswith("test_" + n.split("_")[0]) for k in vars(test_brute)) for n in names)


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
