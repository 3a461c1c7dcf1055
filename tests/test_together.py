"""All pairs with equal similarities beside each other: the same rows, in smaller files."""

import random

import numpy as np
from pyspark.sql import functions as F

from docquill.operators import retrieval as R
from docquill.plans import vectors as P


def test_equal_similarities_stand_together(spark, monkeypatch):
    """The rows of the plain pairs, copies, nulls and odd vectors too, in one run and in many, in one block of queries and in several; each run is by similarity."""
    rng = random.Random(14)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(120)] + [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [1.0, 1.0]]
    rows = [(i, v, str(i)) for i, v in enumerate(vectors)] + [(3, vectors[9], "x"), (None, vectors[5], None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, name string").coalesce(1)
    queries = chunks.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, R.score(chunks, queries).collect()), key=str)
    for most, pairs, together in ((4096, 1 << 20, 1 << 23), (4096, 100, 1000), (5, 7, 40)):
        monkeypatch.setattr(R, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(R, "PAIRS", pairs)
        found = R.score(chunks, queries, together)
        assert found.columns == R.score(chunks, queries).columns and sorted(map(tuple, found.collect()), key=str) == want
    monkeypatch.undo()
    similarity = R.score(chunks, queries, R.TOGETHER).toArrow().column("similarity").to_numpy()
    assert np.count_nonzero(np.diff(similarity)) == len(set(similarity)) - 1
    assert R.score(chunks, queries.limit(0), 10).count() == R.score(chunks.limit(0), queries, 10).count() == 0


def test_different_similarities_stay_in_place():
    """Where more than a third differ, nothing moves; similarities come back as they were."""
    for values in (np.round(np.linspace(-1, 1, 101), 6), np.repeat([0.5, -0.25, 0.0, 1.0, -1.0], 20)[np.random.default_rng(1).permutation(100)], np.zeros(0)):
        key, bits = R._equal_together(iter([values[:40], values[40:]]), len(values))
        at = key & (1 << bits) - 1
        assert sorted(at) == list(range(len(values))) and ((key >> bits) / 1e6 == values[at]).all()
        assert (at == np.arange(len(values))).all() == (len(values) != 100)


def test_pairs_take_fewer_bytes(spark, tmp_path):
    """A million pairs of about 200,000 similarities: what both queries write is less than 0.8 of what the pairs took in the order of chunks."""
    rng = np.random.default_rng(5)
    near = rng.normal(0, 0.28, (7000, 3)) + [1.0, 1.0, 1.0]
    rows = [(i, v, i % 5) for i, v in enumerate(near.astype(np.float32).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet"))

    def total(name):
        return spark.read.parquet(str(tmp_path / name)).agg(F.count("*"), F.sum(F.xxhash64("query_id", "chunk_id", "similarity").cast("decimal(38,0)"))).first()

    plain = R.score(P.vectors_of(spark, str(tmp_path)), P.many_queries(spark, str(tmp_path))).select("query_id", "chunk_id", "similarity")
    least = written(plain, "plain")
    assert written(P.join_cross_similarity(spark, str(tmp_path)), "pairs") < 0.8 * least and total("pairs") == total("plain")
    assert written(P.legacy_threshold_filter(spark, str(tmp_path)), "legacy") < 0.8 * least
