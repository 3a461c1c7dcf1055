"""The approximate index: recall, what it looks at, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.operators import ann, retrieval
from docquill.plans.vectors import ann_index
from docquill.sources.tables import fresh_name


def recall(found, rows, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(q, c) for i, q in enumerate(ids) if q % 50 == 0 for c in ids[np.lexsort((ids, -np.round(x @ x[i], 6)))[:k]]}
    assert len(found) == len(exact)
    return len(exact & {(r.query_id, r.chunk_id) for r in found}) / len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables_with_few_rows_scored(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    assert recall(ann_index(spark, f"/root/testdata/{sf}").collect(), rows) >= 0.9
    scored = ann.RERANK * retrieval.PER_QUERY  # of each query, exactly
    assert sf == "sf0.01" or scored <= 0.15 * len(rows)
    name = ann.index_name(e, "embeddings")
    assert ann.exists(spark, name) and ann.open_index(spark, name).rows().count() == len(rows)


def grouped(spark, n=400, groups=20, size=18):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(groups, size))
    rows = [(i, (centres[i % groups] + rng.normal(size=size) * 0.1).tolist(), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, "chunk_id long, embedding array<double>, doc_id long").repartition(4)


def queries_of(c):
    return c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))


def test_index_is_written_once_and_read_by_name(spark):
    rows, c = grouped(spark)
    name = fresh_name("index")
    assert not ann.exists(spark, name)
    ann.write_index(c, name)
    found = ann.search(ann.open_index(spark, name), queries_of(c), probes=0.2).collect()
    assert recall(found, rows) >= 0.95
    plan = ann.search(ann.open_index(spark, name), queries_of(c).limit(1), probes=0.05)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:200]


def test_exact_where_all_is_looked_at(spark):
    _, c = grouped(spark, 120)
    name = fresh_name("index")
    ann.write_index(c, name)
    same = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.similarity) for r in df.collect())
    index, q = ann.open_index(spark, name), queries_of(c)
    assert same(ann.search(index, q, probes=1.0, rerank=12)) == same(retrieval.best_of_each(c, q, 10, None))
    filtered = ann.search(index, q, probes=1.0, rerank=12, where=F.col("doc_id") == 1)
    assert same(filtered) == same(retrieval.best_of_each(c.where("doc_id = 1"), q, 10, None))


def test_odd_vectors_and_no_rows(spark):
    kinds = "chunk_id long, embedding array<double>"
    rows = [(i, [float(i % 7), 1.0, 0.5]) for i in range(60)] + [(100, None), (101, []), (102, [1.0]), (103, [0.0, 0.0, 0.0]), (104, [1.0, None, 1.0]), (105, [float("nan"), 1.0, 1.0])]
    name, q = fresh_name("index"), spark.createDataFrame([(1, [1.0, 1.0, 0.5]), (2, None), (3, [1.0])], "query_id long, query array<double>")
    ann.write_index(spark.createDataFrame(rows, kinds), name)
    found = ann.search(ann.open_index(spark, name), q, k=3, probes=1.0).collect()
    assert [(r.chunk_id, r.similarity) for r in sorted(found, key=lambda r: r.rank) if r.query_id == 1] == [(1, 1.0), (8, 1.0), (15, 1.0)]
    name = fresh_name("index")
    ann.write_index(spark.createDataFrame([], kinds), name)
    assert ann.search(ann.open_index(spark, name), q).count() == 0


def test_scores_of_odd_vectors_are_zero(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-2.0, 0.0])]
    c, q = spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, query array<double>")
    got = {(r.query_id, r.chunk_id): r.similarity for r in retrieval.score(c, q).collect()}
    assert len(got) == 16 and {k: v for k, v in got.items() if v} == {(1, 1): 1.0, (1, 8): -1.0}
    best = retrieval.best_of_each(c, q, 2, None).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in best) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2)]
    assert retrieval.best_of_each(c, q.limit(0), 2).count() == 0 and retrieval.score(c.limit(0), q).count() == 0


def test_many_queries_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    _, c = grouped(spark, 60)
    q = c.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    assert retrieval.score(c, q).count() == 3600
    best = retrieval.best_of_each(c, q, 1, None).collect()
    assert len(best) == 60 and all(r.query_id == r.chunk_id for r in best)


def test_only_the_best_of_equal_contents_counts(spark):
    rows = [(i, [1.0, i / 10], f"text {i // 3}") for i in range(30)]
    c, q = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, content string").repartition(5), spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    best = sorted((r.rank, r.chunk_id) for r in retrieval.best_of_each(c, q, 4, None, "content").collect())
    assert best == [(1, 0), (2, 3), (3, 6), (4, 9)]
