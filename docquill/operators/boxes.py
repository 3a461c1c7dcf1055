"""Bounding boxes: geometry, and the ordered removal of boxes that repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Most boxes of a page that are compared with each other all at once.
LAGS = 16


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The shared area over the smaller one; 0 where either is empty."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    shared = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    return F.coalesce(F.try_divide(shared, F.nullif(F.least(area(a), area(b)), F.lit(0.0))), F.lit(0.0))


def identical(a: Column, b: Column, tolerance: float = 1.0) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)


def page_pairs(boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(doc_id, page, a, b, overlap, same): all pairs of boxes (doc_id, page, seq, box) of one page, once each, a before b; see :func:`overlapping` for those alone that meet."""
    u, v = (boxes.select(F.col("doc_id").alias(f"{side}_doc_id"), F.col("page").alias(f"{side}_page"), F.col("seq").alias(name), F.col("box").alias(f"{side}_box")) for side, name in (("u", "a"), ("v", "b")))
    pairs = u.join(v, (F.col("u_doc_id") == F.col("v_doc_id")) & (F.col("u_page") == F.col("v_page")) & (F.col("a") < F.col("b")))
    share, same = overlap(F.col("u_box"), F.col("v_box")), identical(F.col("u_box"), F.col("v_box"), tolerance)
    return pairs.select(F.col("u_doc_id").alias("doc_id"), F.col("u_page").alias("page"), "a", "b", share.alias("overlap"), same.alias("same"))


def overlapping(boxes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(doc_id, page, a, b, overlap, same): the pairs of boxes (doc_id, page, seq, box) of one page that share an area or are identical within ``tolerance``, once each, a before b.

    Boxes meet in the cells of a grid, and in the first cell that both touch only.
    Cells have the page's mean box size, and there are at most as many in a page as
    it has boxes, or a few rows and columns more. Boxes without an area have no pairs.
    """
    x0, y0, x1, y1 = (F.col("box")[i] for i in range(4))
    b = boxes.select("doc_id", "page", "seq", "box").where((F.size("box") == 4) & (x1 > x0) & (y1 > y0))
    root = F.ceil(F.sqrt(F.count("*")))
    side = lambda low, high: F.greatest(F.avg(high - low), (F.max(high) - F.min(low)) / root) + tolerance
    grid = b.groupBy(F.col("doc_id").alias("d"), F.col("page").alias("p")).agg(side(x0, x1).alias("w"), side(y0, y1).alias("h"))
    b = b.join(grid, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("page").eqNullSafe(F.col("p"))).drop("d", "p")
    cell = lambda value, size: F.floor(value / F.col(size)).cast("long")
    half = tolerance / 2
    b = b.withColumns({"left": cell(x0 - half, "w"), "right": cell(x1 + half, "w"), "low": cell(y0 - half, "h"), "high": cell(y1 + half, "h")})
    b = b.withColumn("column", F.explode(F.sequence("left", "right"))).withColumn("row", F.explode(F.sequence("low", "high")))
    u, v = (b.select(*[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "page", "seq", "box", "left", "low", "column", "row")]) for side in "uv")
    meet = [F.col(f"u_{c}").eqNullSafe(F.col(f"v_{c}")) for c in ("doc_id", "page", "column", "row")]
    pairs = u.join(v, meet[0] & meet[1] & meet[2] & meet[3] & (F.col("u_seq") < F.col("v_seq")))
    pairs = pairs.where((F.col("u_column") == F.greatest("u_left", "v_left")) & (F.col("u_row") == F.greatest("u_low", "v_low")))
    share, same = overlap(F.col("u_box"), F.col("v_box")), identical(F.col("u_box"), F.col("v_box"), tolerance)
    found = pairs.select(F.col("u_doc_id").alias("doc_id"), F.col("u_page").alias("page"), F.col("u_seq").alias("a"), F.col("v_seq").alias("b"), share.alias("overlap"), same.alias("same"))
    return found.where("overlap > 0 OR same")


class _Kept:
    """Accepted boxes of one page, in order, and grids of squares in which they are found again: a grid for each size of boxes, by powers of two."""

    def __init__(self, share: float, tolerance: float) -> None:
        self.share, self.tolerance, self.boxes = share, tolerance, []
        self.grids: dict[int, dict[tuple[int, int], list[int]]] = {}

    def _put(self, i: int, b: list[float]) -> None:
        level = math.frexp(max(b[2] - b[0], b[3] - b[1]))[1]  # a square is as wide as the box at least
        grid, size = self.grids.setdefault(level, {}), 2.0**level
        for column in range(math.floor(b[0] / size), math.floor(b[2] / size) + 1):
            for row in range(math.floor(b[1] / size), math.floor(b[3] / size) + 1):
                grid.setdefault((column, row), []).append(i)

    def _near(self, b: list[float]) -> list[int]:
        """The places of kept boxes that may touch ``b`` within the tolerance, ascending. A box that was replaced is still found where it was."""
        found: set[int] = set()
        for level, grid in self.grids.items():
            size = 2.0**level
            left, low, right, high = (math.floor((v + m) / size) for v, m in zip(b, (-self.tolerance, -self.tolerance, self.tolerance, self.tolerance), strict=True))
            if (right - left + 1) * (high - low + 1) > len(grid):
                cells = [places for (c, r), places in grid.items() if left <= c <= right and low <= r <= high]
            else:
                cells = [grid[c, r] for c in range(left, right + 1) for r in range(low, high + 1) if (c, r) in grid]
            for places in cells:
                found.update(places)
        return sorted(found)

    def offer(self, seq: int, b: list[float]) -> None:
        size = (b[2] - b[0]) * (b[3] - b[1])
        for i in self._near(b):
            k = self.boxes[i][1]
            if all(abs(x - y) <= self.tolerance for x, y in zip(b, k, strict=True)):
                return
            w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            old = (k[2] - k[0]) * (k[3] - k[1])
            if w > 0 and h > 0 and w * h / min(size, old) >= self.share:
                if size > old:
                    self.boxes[i] = (seq, b)
                    self._put(i, b)
                return
        self.boxes.append((seq, b))
        self._put(len(self.boxes) - 1, b)


def drop_repeated_boxes(boxes: DataFrame, share: float = 0.8, tolerance: float = 1.0) -> DataFrame:
    """(doc_id, page, place, seq, box) of what stays of (doc_id, page, seq, box), a page at a time in order.

    A box identical to a kept one goes; one that overlaps a kept one by ``share``
    of the smaller goes too, but takes its place if it is larger. Boxes without
    an area or with an infinite corner go. The order matters, so a page is a fold,
    read as a stream, in which a box meets its neighbours only.
    """

    def quiet(corners: np.ndarray, first: np.ndarray, fine: np.ndarray) -> np.ndarray:
        """Whether the page of each row, of those that begin at ``first``, has no two boxes that touch within the tolerance; false for a page that holds more than ``LAGS`` rows."""
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(corners))))
        busy = np.diff(np.append(first, len(corners))) > LAGS
        for lag in range(1, min(LAGS, len(corners))):
            at = np.flatnonzero((of[lag:] == of[:-lag]) & fine[lag:] & fine[:-lag])
            if not len(at) and not (of[lag:] == of[:-lag]).any():
                break
            u, v = corners[at], corners[at + lag]
            meet = (u[:, :2] <= v[:, 2:] + tolerance).all(axis=1) & (v[:, :2] <= u[:, 2:] + tolerance).all(axis=1)
            busy[of[at[meet]]] = True
        return ~busy[of]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages are read as they come, cut where a page ends; only those in which boxes meet are folded box by box."""
        key, kept = None, _Kept(share, tolerance)
        columns = ["doc_id", "page", "place", "seq", "box"]

        def out(d, p, place, seq, box) -> pa.RecordBatch:
            values = [d, p, place, seq, box]
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(values, arrow, strict=True)], columns)

        def close() -> list[tuple]:
            return [] if key is None else [(*key, i, s, b) for i, (s, b) in enumerate(kept.boxes)]

        for batch in batches:
            if not batch.num_rows:
                continue
            d, p, s, b = (batch.column(c) for c in ("doc_id", "page", "seq", "box"))
            n = batch.num_rows
            four = pc.fill_null(pc.equal(pc.list_value_length(b), 4), False).to_numpy(zero_copy_only=False)
            corners = np.full((n, 4), np.nan)
            corners[four] = b.filter(pa.array(four)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 4)
            fine = np.isfinite(corners).all(axis=1) & (corners[:, 2] > corners[:, 0]) & (corners[:, 3] > corners[:, 1])
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (d, p)]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)]))
            still = quiet(corners, first, fine)
            # the first page may have begun, and the last may go on
            still[: first[1] if len(first) > 1 else n] = False
            still[first[-1] :] = False
            done: list[tuple] = []
            loud = np.flatnonzero(~still)
            take = pa.array(loud)
            for dd, pp, ss, ok, box in zip(d.take(take).to_pylist(), p.take(take).to_pylist(), s.take(take).to_pylist(), fine[loud].tolist(), corners[loud].tolist(), strict=True):
                if (dd, pp) != key:
                    done += close()
                    key, kept = (dd, pp), _Kept(share, tolerance)
                if ok:
                    kept.offer(ss, box)
            if done:
                yield out(*map(list, zip(*done, strict=True)))
            at = np.flatnonzero(still & fine)
            if len(at):
                page = np.searchsorted(first, at, side="right")
                place = np.arange(len(at)) - np.flatnonzero(np.concatenate([[True], np.diff(page) != 0]))[np.cumsum(np.concatenate([[True], np.diff(page) != 0])) - 1]
                pick = pa.array(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 4), pa.array(corners[at].ravel()))
                yield out(d.take(pick), p.take(pick), pa.array(place.astype(np.int32)), s.take(pick), lists)
        if done := close():
            yield out(*map(list, zip(*done, strict=True)))

    ordered = boxes.select("doc_id", "page", "seq", "box").repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "seq", "box")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    arrow = [*[to_arrow_type(ordered.schema[c].dataType) for c in ("doc_id", "page")], pa.int32(), to_arrow_type(ordered.schema["seq"].dataType), pa.list_(pa.float64())]
    return ordered.mapInArrow(fold, f"doc_id {kinds['doc_id']}, page {kinds['page']}, place int, seq {kinds['seq']}, box array<double>")
