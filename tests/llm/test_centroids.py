"""Centroid clustering against plain rounds in Python integers."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.llm import centroids
from tests.conftest import SF


def plain_rounds(rows, k=40, rounds=5, dims=64, scale=256, seed="2:"):
    """A Counter of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    fine = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if fine(v)]
    rank = lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=rank)[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for last in [*[False] * rounds, True]:
        near = [min((distance(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if not last:
            for n in range(len(centres)):
                own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                centres[n] = [sum(x) // len(own) for x in zip(*own)] if own else centres[n]
    per = collections.Counter()
    for d, n in near if kept else []:
        per[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return collections.Counter((i, n, d, per[n], sum(per.values()), sha[n]) for (i, _), (d, n) in zip(kept, near)) if kept else collections.Counter()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.drop("compared").collect())


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in ("v", "key", "salt", "cluster", "distance", "rank", "ids", "rows", "label")}) if clash else df


def near_points(rng, n, dims, groups):
    at = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.05) for c in at[i % groups]]) for i in range(n)]


@pytest.mark.parametrize("block", [1, 4, 256])
def test_rounds_over_odd_rows(spark, block):
    rng = random.Random(block)
    rows = near_points(rng, 90, 3, 6)
    rows += [(200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0]), (203, [math.nan, 0.0, 0.0]), (204, [math.inf, 0.0, 0.0]), (205, [])]
    rows += [(300, [0.0, 0.0, 0.0])] * 5 + [(i, [0.5, -0.5, 0.25]) for i in range(301, 340)] + [(None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 0.5])]
    got = centroids.centroid_clusters(frame(spark, rows), k=7, rounds=3, dims=3, block=block)
    assert rows_of(got) == plain_rounds(rows, 7, 3, 3)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.9, 0.2])]
    assert rows_of(centroids.centroid_clusters(frame(spark, rows), dims=2)) == plain_rounds(rows, dims=2)
    none = centroids.centroid_clusters(frame(spark, []), dims=2)
    assert none.count() == 0 and none.columns[0] == "vec_id"


def test_large_components(spark):
    rows = [(i, [i * 7919 % 1000 * 400.3, -i * 104729 % 1000 * 377.7]) for i in range(60)]
    assert rows_of(centroids.centroid_clusters(frame(spark, rows), k=5, rounds=2, dims=2)) == plain_rounds(rows, 5, 2, 2)
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(frame(spark, [(1, [1e9, 0.0])]), dims=2)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = centroids.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_few_candidates(spark):
    """Where vectors lie in groups, a block meets a small share of the centroids."""
    rows = near_points(random.Random(3), 2000, 6, 40)
    got = centroids.centroid_clusters(frame(spark, rows, False), dims=6, block=16).agg(F.avg("compared")).first()[0]
    assert got < 20


def test_query_on_the_tables(spark):
    from docquill.llm.queries import op13_hilbert_centroids

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(op13_hilbert_centroids(spark, SF)) == plain_rounds(rows)
