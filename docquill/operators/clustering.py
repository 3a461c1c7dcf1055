"""k-means over chunk vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.scratch import materialize


def cluster_count(n: Column, least: int = 4, most: int = 10) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n / 20))).cast("int")


#: Rows that the starts are drawn from; passes over the points at most, and the share of the cost that a pass must save.
SEEDS, PASSES, LEAST_GAIN = 10_000, 24, 1e-6


def spread_starts(x: np.ndarray, k: int, tries: int, seed: int) -> np.ndarray:
    """(tries, k, dimensions): starts among the rows of a sample, each drawn by its squared distance to those before it."""
    rng = np.random.default_rng(seed)
    starts = np.empty((tries, k, x.shape[1]))
    for t in range(tries):
        least = np.full(len(x), np.inf)
        at = int(rng.integers(len(x)))
        for i in range(k):
            starts[t, i] = x[at]
            least = np.minimum(least, ((x - x[at]) ** 2).sum(axis=1))
            at = int(rng.choice(len(x), p=least / least.sum())) if least.sum() > 0 else int(rng.integers(len(x)))
    return starts


def nearest_of_tries(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tries, rows) the nearest centre of each try, ties to the smaller number, and the squared distance to it; one matrix product."""
    tries, k, size = centres.shape
    flat = centres.reshape(-1, size)
    d = ((flat * flat).sum(axis=1) - 2 * (x @ flat.T)).reshape(len(x), tries, k)
    near = d.argmin(axis=2).T
    least = np.take_along_axis(d, near.T[:, :, None], axis=2)[:, :, 0].T + (x * x).sum(axis=1)
    return near, np.maximum(least, 0.0)


def moved_centres(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the means of all tries' clusters (an empty one stays where it is), and the cost of each try before it."""
    tries, k, size = centres.shape
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        total, count, cost = np.zeros((tries, k, size)), np.zeros((tries, k), np.int64), np.zeros((tries, k))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            near, least = nearest_of_tries(x, shared.value)
            for t in range(tries):
                count[t] += np.bincount(near[t], minlength=k)
                cost[t] += np.bincount(near[t], least[t], k)
                order = np.argsort(near[t], kind="stable")
                first = np.flatnonzero(np.diff(near[t][order], prepend=-1))
                total[t, near[t][order][first]] += np.add.reduceat(x[order], first, axis=0) if len(first) else 0.0
        some = np.flatnonzero(count.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), pa.array(total.reshape(-1, size)[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count.ravel()[some]), pa.array(cost.ravel()[some]), lists], ["c", "n", "cost", "total"])

    parts = points.select("v").mapInArrow(run, "c int, n long, cost double, total array<double>")
    found = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)]).collect()  # a row a centre
    after, costs = centres.reshape(-1, size).copy(), np.zeros(tries)
    for r in found:
        after[r.c] = np.array([r[f"t{i}"] for i in range(size)]) / r.n
        costs[r.c // k] += r.cost
    return after.reshape(centres.shape), costs


def clusters(chunks: DataFrame, least: int = 4, most: int = 10, tries: int = 10, seed: int = 42) -> DataFrame:
    """``chunks`` with ``cluster``: the best of ``tries`` starts by cost. With fewer chunks than clusters, each is on its own.

    All tries move in the same passes over the points, which are written once; a
    task returns a sum for each centre. The starts are drawn from about ``SEEDS``
    rows by hash. A chunk without a vector, or with one of another length than most
    of these or with a null or infinite component, has a null cluster.
    """
    n = chunks.count()
    k = min(most, max(least, n // 20))
    if n < k:
        return chunks.withColumn("cluster", F.row_number().over(Window.orderBy("chunk_id")) - 1)  # at most ``least`` rows
    draw = chunks.where(F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(1_000_003)) < F.lit(math.ceil(1_000_003 * min(1.0, SEEDS / n))))
    sample = [r.embedding for r in draw.select("embedding").collect() if r.embedding is not None]  # about SEEDS rows
    lengths = [len(v) for v in sample]
    size = max(set(lengths), key=lengths.count) if lengths else 0
    whole = [v for v in sample if len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    if not size or not whole:
        return chunks.withColumn("cluster", F.lit(None).cast("int"))
    rows = np.array(whole, float)
    fine = (F.size("embedding") == size) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    points = materialize(chunks.where(fine).select("chunk_id", F.transform("embedding", lambda c: c.cast("double")).alias("v")), "points")
    centres, before = spread_starts(rows, k, tries, seed), np.full(tries, np.inf)
    for _ in range(PASSES):
        after, costs = moved_centres(points, centres)
        best = centres[int(costs.argmin())]
        if (before - costs <= LEAST_GAIN * np.maximum(costs, 1e-300)).all():
            break
        centres, before = after, costs
    shared = points.sparkSession.sparkContext.broadcast(best[None])
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(nearest_of_tries(x, shared.value)[0][0], pa.int32())], ["chunk_id", "cluster"])

    return chunks.join(points.mapInArrow(assign, f"chunk_id {kind}, cluster int"), "chunk_id", "left")


def cluster_summaries(labelled: DataFrame, shown: int = 3, chars: int = 150) -> DataFrame:
    """(cluster, n, samples): size and the first contents, cut and joined by a bar. Only the first ``shown`` of each part of a cluster are held."""
    size = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    text = F.substring(F.coalesce("content", F.lit("")), 1, chars).alias("text")
    part = Window.partitionBy("cluster", "part").orderBy("chunk_id")
    few = labelled.select("cluster", "chunk_id", text, F.pmod(F.xxhash64("chunk_id"), F.lit(64)).alias("part")).withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= shown)
    first = few.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy("chunk_id"))).where(F.col("rn") <= shown)
    samples = first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))).alias("s"))
    return size.join(samples, "cluster").select("cluster", "n", F.array_join(F.transform("s", lambda x: x["text"]), " | ").alias("samples"))
