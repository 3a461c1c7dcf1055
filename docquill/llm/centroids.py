"""Lloyd's rounds over blocks of vectors in Hilbert order; each block is compared with the centroids that its box allows.

Vectors become integers, so that every result is exact. They are sorted along a
Hilbert curve through the coordinates that vary most and packed into blocks of
``BLOCK`` rows with the least and the greatest value of every coordinate, written
once. A round reads the blocks: a centroid whose least distance to a block's box
is above the smallest of the greatest distances cannot be nearest to any row of
it; the others are compared exactly, by one matrix product. Tasks return one sum
and count a cluster. Only the centroids are on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.scratch import materialize

#: Rows of a block; coordinates of the curve and bits of each.
BLOCK, CURVE, BITS = 256, 16, 4
#: Up to this amount of the components, products in doubles are exact; beyond it integers are used, and above ``MOST`` distances would not be longs.
DOUBLES, MOST = 1 << 21, 1 << 27


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, *more: Column) -> DataFrame:
    """(vec_id, v, more columns): the vectors of ``dims`` components, none null or not finite, each component as floor(scale * x)."""
    x = F.col(f"`{vector_col}`")
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    times = lambda c: F.floor(c.cast("double") * scale)
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) * scale <= MOST, times(c)).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}"))).cast("int"))
    return vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(fine, whole).alias("v"), *more).where("v IS NOT NULL")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The places along the Hilbert curve (as longs in the same order) of (n, d) whole numbers below 2**bits; d * bits is 64 at most."""
    x = points.T.astype(np.int64)
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | (x[i] >> b & 1).astype(np.uint64)
    return (key ^ np.uint64(1 << 63 if d * bits == 64 else 0)).view(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(rows, centroids) of whole numbers, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= DOUBLES:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def candidates(low: np.ndarray, high: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroids, ascending, that may be nearest to a point of the box. Ties with the bound stay."""
    c = c.astype(np.float64)  # up to 2**62, rounded: hence the slack
    least = (np.maximum(np.maximum(low - c, c - high), 0.0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(c - low), np.abs(c - high)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min(initial=np.inf) * (1 + 1e-9))


def hilbert_blocks(points: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """``points`` (vec_id, v) as a written table of blocks: ids, rows (their components one after the other), low, high.

    Equal vectors are dealt out by a hash, so that a vector of any frequency fills many blocks.
    """
    id_type = points.schema["vec_id"].dataType.simpleString()
    spans = points.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.stddev_pop("x").alias("spread")).collect()  # ``dims`` rows
    spans.sort(key=lambda r: (-r.spread, r.at))
    axes = [(r.at, r.low, r.high) for r in spans[:CURVE]]

    def keyed(batches):
        at, low, high = (np.array(a, np.int64) for a in zip(*axes, strict=True))
        for batch in batches:
            v = _matrix(batch.column("v"), dims)[:, at].astype(np.int64)
            cells = ((v - low) << BITS) // (high - low + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, BITS))], [*batch.schema.names, "key"])

    def packed(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                full = rows.num_rows // block * block
                yield _packed(rows.slice(0, full), dims, block)
                held = [rows.slice(full)]
        rows = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rows and rows[0].num_rows:
            yield _packed(rows[0], dims, block)

    if not axes:
        ordered = points
    else:
        salted = points.mapInArrow(keyed, f"vec_id {id_type}, v array<int>, key long").withColumn("salt", F.xxhash64("vec_id", F.monotonically_increasing_id()))
        ordered = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt").select("vec_id", "v")
    return materialize(ordered.mapInArrow(packed, f"ids array<{id_type}>, rows array<int>, low array<int>, high array<int>"), "hilbert-blocks")


def _packed(rows: pa.RecordBatch, dims: int, block: int) -> pa.RecordBatch:
    v = _matrix(rows.column("v"), dims)
    starts = np.arange(0, len(v), block)
    cuts = np.append(starts, len(v))
    lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    sides = [lists(pa.array(f.reduceat(v, starts, axis=0).ravel(), pa.int32()), np.arange(len(starts) + 1) * dims) for f in (np.minimum, np.maximum)]
    return pa.RecordBatch.from_arrays([lists(rows.column("vec_id"), cuts), lists(pa.array(v.ravel(), pa.int32()), cuts * dims), *sides], ["ids", "rows", "low", "high"])


def _nearest(batches, centroids: np.ndarray, dims: int):
    """For each block its place in the batch, rows, nearest centroids, distances and number of candidates."""
    for batch in batches:
        low, high = _matrix(batch.column("low"), dims), _matrix(batch.column("high"), dims)
        rows = batch.column("rows")
        for i in range(batch.num_rows):
            x = rows[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
            some = candidates(low[i], high[i], centroids)
            d = squared_distances(x, centroids[some])
            best = d.argmin(axis=1)
            yield batch, i, x, some[best], d[np.arange(len(x)), best], len(some)


def moved(blocks: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each cluster's vectors; an empty cluster's stays."""

    def sums(batches):
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, _, x, near, _, _ in _nearest(batches, centroids, dims):
            order = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.diff(near[order], prepend=-1))
            here = near[order][first]
            total[here] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
            count[here] += np.diff(np.append(first, len(x)))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = blocks.select("rows", "low", "high").mapInArrow(sums, "cluster int, n long, total array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims)]).collect()  # a row a centroid
    after = centroids.copy()
    for r in found:
        after[r.cluster] = [r[f"t{i}"] // r.n for i in range(dims)]
    return after


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", block: int = BLOCK
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) of the vectors with ``dims`` components.

    The first centroids are the vectors with the smallest SHA-256 of ``seed`` and
    the id (a null id: nothing; ties by the vector), fewer where there are fewer
    vectors. Equal distances go to the smaller number; an empty cluster keeps its
    centroid. ``compared`` is the number of centroids that the row's block was
    compared with. Vectors that are null, of another length or with a null or
    infinite component take no part; rows that repeat, in id or in whole, are rows
    of their own; other columns are not looked at; an empty table gives an empty
    result. A component above 2**27 / ``scale`` in amount is an error.
    """
    spark = vectors.sparkSession
    points = quantised(vectors, id_col, vector_col, dims, scale)
    rank: Column = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = points.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()  # ``k`` rows
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    blocks = hilbert_blocks(points, dims, block)
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dims)
    final = centroids

    def assign(batches):
        for batch, i, _, near, distance, compared in _nearest(batches, final, dims):
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, pa.array(near, pa.int32()), pa.array(distance), pa.array(np.full(len(near), compared), pa.int32())], ["vec_id", "cluster", "distance", "compared"]
            )

    id_type = points.schema["vec_id"].dataType.simpleString()
    rows = materialize(blocks.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long, compared int"), "nearest-centroids")
    sizes = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(final)]
    known = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(sizes, "cluster").crossJoin(sizes.agg(F.sum("cluster_inertia").alias("inertia")))
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")  # ``k`` rows


def centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> str:
    """DuckDB SQL of :func:`centroid_clusters` over ``embeddings``, a step for each round."""
    product = lambda a, b: f"CAST(list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS BIGINT)"
    steps = [
        f"""kept AS (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        distance = f"{product('k.v', 'k.v')} - 2 * {product('k.v', 'c.v')} + {product('c.v', 'c.v')}"
        steps.append(f"a{i} AS (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS near FROM (SELECT k.vec_id, k.v, c.c, {distance} AS d FROM kept k, c{i} c) GROUP BY vec_id)")
        if i < rounds:
            floored = "CAST((s - ((s % n) + n) % n) / n AS BIGINT)"
            steps.append(f"x{i} AS (SELECT near.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{i})")
            steps.append(f"s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x{i} GROUP BY c, i)")
            steps.append(f"m{i} AS (SELECT c, list({floored} ORDER BY i) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(near.c AS INT) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.c) AS BIGINT) AS cluster_inertia, CAST(sum(near.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = near.c"""
