"""Hard negatives against all pairs in Python integers."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquill.llm import hard_negatives as H
from tests.conftest import SF


def plain(rows, anchor, dims, positives=5, negatives=3, share=(50, 95), scale=256):
    fine = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * float(x)) for x in v], y) for i, v, y in rows if fine(v) and y is not None]
    out = collections.Counter()
    for n, (i, v, y) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, z, j) for m, (j, w, z) in enumerate(kept) if m != n)
        for s, _, _, _, j in [r for r in scored if r[3] == y][:positives]:
            window = [r for r in scored if r[3] != y and share[0] * -s <= 100 * -r[0] <= share[1] * -s]
            for rank, r in enumerate(window[:negatives], 1):
                out[i, j, rank, r[4], -s, -r[0]] += 1
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit(1) for c in ("v", "row", "anchor", "cell", "d", "ids", "rank", "score", "block", "least")})


def points(rng, n, dims, groups, labels):
    at = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.3) for c in at[i % groups]], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("page,block", [(5, 7), (64, 1000), (2048, 4096)])
def test_odd_rows(spark, page, block):
    rng = random.Random(page)
    rows = points(rng, 260, 4, 5, 3)
    rows += [(400, None, 1), (401, [1.0, 2.0], 1), (402, [1.0, None, 2.0, 1.0], 1), (403, [math.nan, 0.0, 0.0, 1.0], 0), (404, [math.inf, 0.0, 0.0, 1.0], 0), (405, [1.0] * 4, None), (406, [], 0)]
    rows += [(500 + i // 2, [0.9, 1.1, 0.0, 0.2], i % 3) for i in range(40)] + [(None, [1.0, 1.0, 1.0, 0.5], 1), (None, [0.7, 0.6, 0.1, 0.0], 0), (10, [0.0] * 4, 0), (20, [-1.0] * 4, 2)]
    got = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, dims=4, page=page, block=block)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0, 4)


def test_few_and_no_rows(spark):
    few = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2)]
    found = lambda rows: collections.Counter(tuple(r) for r in H.hard_negatives(frame(spark, rows), F.col("vec_id") == 0, dims=2).collect())
    assert found(few) == plain(few, lambda i: i == 0, 2) and found(few)
    assert not found([]) and not found([(0, [1.0, 0.0], 1)]) and not found([(1, [1.0, 0.0], 1)] * 9)


def test_large_scores(spark):
    rows = [(i, [(i * 7919 % 1000 - 300) * 300.25, (i * 104729 % 1000) * 277.5], i % 2) for i in range(80)]
    got = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, dims=2)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0, 2)


def test_subtrees_are_left_out():
    """Of vectors in groups only a small share is scored."""
    rng = np.random.default_rng(5)
    groups = rng.normal(0, 200, (40, 8))
    v = np.floor(groups[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 8))).astype(np.int64)
    space = H.Space(int((v * v).sum(axis=1).max()))
    root = v[H.far_apart(v[:1000], H.ROOT)]
    lifted = space.lifted(root)
    import pyarrow as pa

    near = space.between(space.lifted(v), lifted).argmin(axis=1)
    pages = []
    for c in range(len(root)):
        some = np.flatnonzero(near == c)
        if len(some):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * 8, pa.int32()), pa.array(v[some].ravel(), pa.int32()))
            pages.append(H._page(pa.RecordBatch.from_arrays([pa.array(some), flat, pa.array(some % 3), pa.array(some % 50 == 0), pa.array(some)], ["vec_id", "v", "label", "anchor", "row"]), lifted, space, 8))
    q = np.arange(0, 4000, 50)
    s = H.scores(v[q], v)
    fifth = np.sort(np.where((q[:, None] % 3 == np.arange(4000) % 3) & (q[:, None] != np.arange(4000)), s, H._NONE), axis=1)[:, -5]
    best, looked = H.searched(pages, root, space, 8, v[q], q % 3, q, np.arange(len(q)), fifth, np.full(len(q), H.NO_ID), 5, True)
    assert len(best.of) == 5 * len(q) and best.least.tolist() == fifth.tolist()
    assert looked < 0.2 * s.size


def test_query_on_the_tables(spark):
    from docquill.llm.queries import op12_gnat_negatives

    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert collections.Counter(tuple(r) for r in op12_gnat_negatives(spark, SF).collect()) == plain(rows, lambda i: i % 50 == 0, 64)
