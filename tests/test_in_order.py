"""All pairs in order: the same rows as a sort by columns, in ranges, without a row a pair in the shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.operators import retrieval as R


@pytest.mark.parametrize("ids", ["near", "far", "text"])
def test_pairs_in_order(spark, ids):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (400, 8)).astype("float32").tolist()
    vectors[5], vectors[6], vectors[7] = None, [0.0] * 8, vectors[8]
    name = {"near": lambda i: i - 50, "far": lambda i: i * (1 << 54), "text": lambda i: f"c{i}"}[ids]
    kind = "string" if ids == "text" else "long"
    rows = [(name(i), v) for i, v in enumerate(vectors)] + [(name(8), vectors[8])]
    chunks = spark.createDataFrame(rows, f"chunk_id {kind}, embedding array<float>")
    queries = spark.createDataFrame([(name(i), vectors[i]) for i in (0, 5, 8, 50, 100)], f"query_id {kind}, query array<float>")
    known = F.when(F.xxhash64("chunk_id") % 4 != 0, True)
    plain = R.score(chunks, queries).select("query_id", "chunk_id", F.coalesce(F.when(known, F.col("similarity")), F.lit(0.0)).alias("similarity"))
    got = R.in_order(chunks, queries, known, sorted_pairs=150)
    rows = [tuple(r) for r in got.collect()]
    assert rows == [tuple(r) for r in plain.orderBy(F.desc("similarity"), "query_id", "chunk_id").collect()] and len(rows) == 2005
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("rangepartitioning" in plan) == (ids != "near")
    if ids == "near":
        sizes = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 8 and max(r["count"] for r in sizes) < 450  # ranges are sorted apart
    assert R.in_order(chunks.limit(0), queries, known).count() == 0 and R.in_order(chunks, queries.limit(0), known).count() == 0
