"""All pairs in order: what is shuffled is two to three bytes a pair, and the rows stay those of a sort by columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquill.operators import retrieval as R


def shuffled(spark, group):
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    done = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s) and tracker.getStageInfo(s).numCompletedTasks}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in done)


def in_columns(chunks, queries, known):
    """The rows in order, worked out from the plain pairs."""
    plain = R.score(chunks, queries).select("query_id", "chunk_id", F.coalesce(F.when(known, F.col("similarity")), F.lit(0.0)).alias("similarity")).toArrow()
    query, chunk, similarity = (plain.column(n).to_numpy() for n in ("query_id", "chunk_id", "similarity"))
    order = np.lexsort((chunk, query, -similarity))
    return query[order], chunk[order], similarity[order]


def same(found: pa.Table, want) -> bool:
    return all((found.column(n).to_numpy() == w).all() and found.num_rows == len(w) for n, w in zip(("query_id", "chunk_id", "similarity"), want, strict=True))


def test_pairs_take_few_bytes_in_the_shuffle(spark):
    """Four million pairs; before, each took six bytes or more."""
    rng = np.random.default_rng(7)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (4000, 8)).astype("float32").tolist())]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = chunks.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    known = F.col("chunk_id") % 4 > 0
    found = R.in_order(chunks, queries, known, sorted_pairs=1 << 18)
    spark.sparkContext.setJobGroup("dealt pairs", "")
    table = found.toArrow()
    spark.sparkContext.setJobGroup("", "")
    assert same(table, in_columns(chunks, queries, known))
    assert 0 < shuffled(spark, "dealt pairs") < 3 * 4_000_000


@pytest.mark.parametrize("sorted_pairs", [40, 700, 1 << 22])
def test_ids_out_of_order_and_in_blocks(spark, monkeypatch, sorted_pairs):
    """Ids far apart, in any order and more than once; few similarities, so that bounds are between equal ones; several blocks of queries."""
    rng = np.random.default_rng(11)
    ids = rng.choice(1 << 20, 300, replace=False) - (1 << 19)
    vectors = rng.integers(-1, 2, (300, 3)).astype(float).tolist()
    vectors[4], vectors[5], vectors[6] = None, [], [float("nan")] * 3
    rows = [(int(i), v) for i, v in zip(ids, vectors, strict=True)] + [(int(ids[9]), vectors[10])] * 3
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows[::10] + rows[-1:], "query_id long, query array<double>")
    known = F.pmod(F.col("chunk_id"), F.lit(4)) != 0
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 7)
    found = R.in_order(chunks, queries, known, sorted_pairs=sorted_pairs)
    assert found.dtypes == [("query_id", "bigint"), ("chunk_id", "int"), ("similarity", "double")]
    assert same(found.toArrow(), in_columns(chunks, queries, known))
