"""Hard negatives by a tree of split points with distance ranges to the subtrees beside them.

An inner product becomes a distance: with one more component, all vectors get
the length of the longest (an anchor's is zero), and a high score is a short
distance. The root's split points come from a bounded sample; each vector
belongs to its nearest one, and the vectors of a subtree fill pages of at most
``PAGE`` rows in the order of that distance, written once. A page keeps, for every
split point of the root, the range of distances to its rows, and is a node itself:
split points of its own, their leaves, and each one's ranges to the leaves beside
it. A search is an annulus about the anchor: a page or leaf whose range from any
split point does not meet the annulus has no row in it. The rows of the leaves
that remain are scored exactly, by a matrix product.

Anchors are taken in blocks of ``ANCHORS``; a task keeps the best few of each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.llm.centroids import DOUBLES, _matrix, quantised
from docquill.scratch import materialize

#: Split points of the root and of a page, rows of the sample that they come from, rows of a page, anchors of a block.
ROOT, INNER, SAMPLE, PAGE, ANCHORS = 32, 16, 1024, 2048, 4096
#: A null id while ids are numbers; it comes after all others.
NO_ID = (1 << 63) - 1
_NONE = np.iinfo(np.int64).min


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(anchors, rows): exact inner products."""
    if max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) <= DOUBLES:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class Space:
    """Distances between vectors that all have the length of the longest, ``radius``, by one more component."""

    def __init__(self, longest: int) -> None:
        self.longest, self.slack = float(longest), 1e-6 * (1 + longest) ** 0.5

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0.0))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors; all pairs."""
        return np.sqrt(np.maximum(2 * self.longest - 2 * (a @ b.T), 0.0))

    def anchors(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Distances of anchors, which have no further component, to split points."""
        return self.at(q, q.astype(np.float64) @ p.astype(np.float64).T)

    def at(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that a score is at, for each anchor."""
        own = (q.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(own[:, None] + self.longest - 2.0 * score, 0.0))


def far_apart(x: np.ndarray, many: int) -> np.ndarray:
    """Places of up to ``many`` different vectors, each the farthest from those before it."""
    x = x.astype(np.float64)
    chosen, least = [], np.full(len(x), np.inf)
    at = 0
    while len(x) and len(chosen) < many and least[at] > 0:
        chosen.append(at)
        least = np.minimum(least, ((x - x[at]) ** 2).sum(axis=1))
        at = int(least.argmax())
    return np.array(chosen, np.int64)


def meets(delta: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whether rows at low to high from a split point, which is ``delta`` from the anchor, can be at near to far from the anchor."""
    return (low <= delta + far) & (high >= np.maximum(delta - far, near - delta))


def _lists(values: np.ndarray, offsets: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


PAGE_SCHEMA = "ids array<long>, rows array<long>, labels array<long>, anchor array<boolean>, v array<int>, low array<double>, high array<double>, splits array<int>, leaves array<int>, inner_low array<double>, inner_high array<double>"


def _page(rows: pa.RecordBatch, root: np.ndarray, space: Space, dims: int) -> pa.RecordBatch:
    """One page: rows in the order of its leaves, the ranges from the root's split points, and its own split points with ranges to all leaves."""
    v = _matrix(rows.column("v"), dims)
    lifted = space.lifted(v)
    outer = space.between(root, lifted)
    points = far_apart(v, INNER)
    near = space.between(lifted[points], lifted)
    leaf = near.argmin(axis=0)
    order = np.argsort(leaf, kind="stable")
    cuts = np.searchsorted(leaf[order], np.arange(len(points) + 1))  # every split point is in its own leaf
    sides = [f.reduceat(near[:, order], cuts[:-1], axis=1) for f in (np.minimum, np.maximum)]
    take = lambda c, kind: _lists(rows.column(c).to_numpy(zero_copy_only=False)[order], [0, len(v)], kind)
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    columns = [
        take("vec_id", pa.int64()), take("row", pa.int64()), take("label", pa.int64()), take("anchor", pa.bool_()), _lists(v[order], [0, v.size], pa.int32()),
        *[_lists(f(outer, axis=1), [0, len(root)], pa.float64()) for f in (np.min, np.max)], _lists(place[points], [0, len(points)], pa.int32()), _lists(cuts, [0, len(cuts)], pa.int32()),
        *[_lists(s, [0, s.size], pa.float64()) for s in sides],
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in PAGE_SCHEMA.split(", ")])


def distance_pages(points: DataFrame, dims: int, space: Space, root: np.ndarray, page: int = PAGE) -> DataFrame:
    """``points`` (vec_id, v, label, anchor, row) as a written table of pages. Equal vectors fill as many pages as they need."""
    lifted_root = space.lifted(root)

    def routed(batches):
        for batch in batches:
            d = space.between(space.lifted(_matrix(batch.column("v"), dims)), lifted_root)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "d"])

    def packed(batches):
        held: list[pa.RecordBatch] = []

        def pages(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cells = rows.column("cell").to_numpy()
            ends = np.flatnonzero(np.diff(cells, append=-1)) + 1
            start = 0
            for end in ends.tolist():
                while start < end and (end - start >= page or last or end < len(cells)):
                    yield _page(rows.slice(start, min(page, end - start)), lifted_root, space, dims)
                    start += min(page, end - start)
            held[:] = [rows.slice(start)] if start < len(cells) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from pages(False)
        if held:
            yield from pages(True)

    kinds = "vec_id long, v array<int>, label long, anchor boolean, row long, cell int, d double"
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = points.mapInArrow(routed, kinds).repartitionByRange(parts, "cell", "d", "row").sortWithinPartitions("cell", "d", "row")
    return materialize(ordered.mapInArrow(packed, PAGE_SCHEMA), "distance-pages")


class _Opened:
    """A page as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int) -> None:
        get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
        self.ids, self.rows, self.labels, self.anchor, self.v = get("ids"), get("rows"), get("labels"), get("anchor"), get("v").reshape(-1, dims)
        self.low, self.high, self.splits, self.leaves = get("low"), get("high"), get("splits"), get("leaves")
        many = len(self.splits)
        self.inner_low, self.inner_high = get("inner_low").reshape(many, many), get("inner_high").reshape(many, many)


class Best:
    """The best ``k`` (score, id) of each search, and the score that a further row must reach."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.of, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(of):
            return
        of, score, ids = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        last = rank == self.k - 1
        self.least[of[last]] = np.maximum(self.least[of[last]], score[last])
        keep = rank < self.k
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]


def searched(pages, root: np.ndarray, space: Space, dims: int, q: np.ndarray, labels: np.ndarray, rows: np.ndarray, owner: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[Best, int]:
    """The best ``k`` rows of each search within its scores, of the anchor's label or of another; and the number of scores worked out.

    Search i is about the anchor ``owner[i]`` and admits scores from ``least[i]`` to ``most[i]``.
    """
    best, looked = Best(k, least), 0
    to_root = space.anchors(q, root)
    own = q[owner]
    near = np.maximum(space.at(own, most[:, None])[:, 0] - space.slack, 0.0)
    for batch in pages:
        for i in range(batch.num_rows):
            page = _Opened(batch, i, dims)
            far = space.at(own, best.least[:, None].astype(np.float64))[:, 0] + space.slack
            alive = np.flatnonzero((best.least <= most) & meets(to_root[owner], page.low, page.high, near[:, None], far[:, None]).all(axis=1))
            if not len(alive):
                continue
            to_split = space.anchors(own[alive], page.v[page.splits])
            n, f = near[alive, None], far[alive, None]
            for j, (a, b) in enumerate(zip(page.leaves[:-1].tolist(), page.leaves[1:].tolist(), strict=True)):
                open_ = alive[meets(to_split, page.inner_low[:, j], page.inner_high[:, j], n, f).all(axis=1)]
                open_ = open_[best.least[open_] <= most[open_]]
                if not len(open_):
                    continue
                anchors, of = np.unique(owner[open_], return_inverse=True)
                s = scores(q[anchors], page.v[a:b])
                looked += s.size
                fits = (labels[anchors][:, None] == page.labels[a:b]) == same
                if same:
                    fits &= rows[anchors][:, None] != page.rows[a:b]
                s = s[of]
                at, row = np.nonzero(fits[of] & (s >= best.least[open_][:, None]) & (s <= most[open_][:, None]))
                best.add(open_[at], s[at, row], page.ids[a:b][row])
    return best, looked


def _anchors_of(pages: DataFrame, dims: int, k: int) -> DataFrame:
    """(row, id, label, v, least): the anchors, each with the ``k``-th score of its label within its own page, which the best ``k`` of all reach."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                page = _Opened(batch, i, dims)
                at = np.flatnonzero(page.anchor)
                if not len(at):
                    continue
                s = np.where((page.labels[at][:, None] == page.labels) & (page.rows[at][:, None] != page.rows), scores(page.v[at], page.v), _NONE)
                found = np.partition(s, -k, axis=1)[:, -k] if len(page.v) >= k else np.full(len(at), _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page.rows[at]), pa.array(page.ids[at]), pa.array(page.labels[at]), _lists(page.v[at], np.arange(len(at) + 1) * dims, pa.int32()), pa.array(found)], ["row", "id", "label", "v", "least"]
                )

    return pages.mapInArrow(run, "row long, id long, label long, v array<int>, least long")


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", dims: int = 64, scale: int = 256,
    positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), page: int = PAGE, block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row that ``anchor`` holds for.

    Scores are inner products of floor(scale * x); the higher comes first, then
    the smaller id (null last). The positives of an anchor are its first other
    rows of the same label; the negatives of a positive the first rows of another
    label whose score is between ``share`` percent of the positive's. Rows with a
    null label or vector, another number of components, or a null or infinite one
    take no part. Ids and labels are whole numbers; the id 2**63 - 1 reads as
    null. Rows that repeat, in id or in whole, are rows of their own, as anchors,
    positives and negatives; other columns are not looked at; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    label = (F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col).cast("long")
    points = quantised(vectors, id_col, vector_col, dims, scale, label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("label IS NOT NULL")
    points = points.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), "v", "label", "anchor")
    length = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    space = Space(points.agg(F.max(length)).first()[0] or 0)
    sample = np.array([r.v for r in points.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()], np.int64).reshape(-1, dims)  # bounded
    root = sample[far_apart(sample, ROOT)]
    pages = distance_pages(points.withColumn("row", F.monotonically_increasing_id()), dims, space, root, page)
    found = materialize(_anchors_of(pages, dims, positives), "anchors")
    blocks = -(-found.count() // block) or 1
    found = materialize(found.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "anchor-blocks", by="block")

    def best_rows(asked: list, k: int, same: bool) -> DataFrame:
        """(row, search, id, score): the best ``k`` of the searches of one block of anchors, found by tasks and then ranked among them."""
        q = np.array([r.v for r in asked], np.int64).reshape(-1, dims)
        rows, labels = (np.array([getattr(r, c) for r in asked], np.int64) for c in ("row", "label"))
        searches = [(i, n, low, high) for i, r in enumerate(asked) for n, (low, high) in enumerate(r.windows)]
        owner, ordinal, least, most = np.array(searches, np.int64).reshape(-1, 4).T
        shared = spark.sparkContext.broadcast((root, space, dims, q, labels, rows, owner, least, most, k, same))  # ``block`` anchors

        def run(batches):
            best, _ = searched(batches, *shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[owner[best.of]], ordinal[best.of], best.id, best.score)], ["row", "search", "id", "score"])

        of_search = Window.partitionBy("row", "search").orderBy(F.desc("score"), "id")
        parts = pages.mapInArrow(run, "row long, search long, id long, score long")
        return parts.withColumn("rank", F.row_number().over(of_search)).where(F.col("rank") <= k)

    def in_blocks(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        return reduce(DataFrame.unionByName, [materialize(best_rows(anchors.where(F.col("block") == i).collect(), k, same), "best-rows") for i in range(blocks)])

    anywhere = F.array(F.struct(F.col("least").alias("low"), F.lit(NO_ID).alias("high")))
    first = in_blocks(found.withColumn("windows", anywhere), positives, True)
    part = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100  # noqa: E731  exact, as two digits are enough
    low, high = F.ceil(part(share[0])), F.floor(part(share[1]))
    window = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    by_anchor = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", window.alias("w")))).alias("w"))
    asked = found.join(by_anchor, "row").select("row", "label", "v", "block", F.transform("w", lambda x: x["w"]).alias("windows"))
    second = in_blocks(materialize(asked, "anchor-windows", by="block"), negatives, False)
    pairs = first.select("row", (F.col("rank") - 1).cast("long").alias("search"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    whole = second.select("row", "search", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "search"]).join(found.select("row", F.col("id").alias("anchor_id")), "row")
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return whole.select(given("anchor_id"), given("positive_id"), "rank", given("negative_id"), "positive_score", "negative_score")
