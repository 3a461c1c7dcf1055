"""Values that lie just between two whole numbers, held against DuckDB."""

import duckdb
import pytest

from docquill import plans


@pytest.mark.parametrize("name", ["doc_type", "partition_strategy", "sample_size", "table_validation"])
def test_characters_of_a_page_at_halves(spark, tmp_path, name):
    """DuckDB takes the even one of two numbers that are equally near."""
    path = f"{tmp_path}/orders.parquet"
    halves = [float(40 * n + 20) for n in range(-3, 400)] + [40.0 * 5000 + 20, 40.0 * 10**6 + 20]
    spark.createDataFrame([(2 * i + 4, 3 * i, p) for i, p in enumerate(halves)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{path}/*.parquet'")
    got = plans.queries()[name](spark, str(tmp_path))
    want = con.sql(plans.oracles()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
