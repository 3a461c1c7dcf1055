"""Running values within groups of which some are larger than a task should hold.

Groups of ordinary size are plain windows. The rows of giant groups are sorted by
range and numbered, so that a group is many segments; each segment is a window of
its own and folds to one row (its count, its last value), these rows are combined
in the order of the segments, and what stood before a segment is joined back to
its rows. Every task has a bounded number of rows of a giant group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.scratch import materialize

#: Rows above which a group is a giant; binary digits of the number of rows of a segment.
GIANT, SEGMENT_BITS = 1 << 18, 14


def giants(rows: DataFrame, group: list[str], most: int = GIANT) -> DataFrame | None:
    """The keys of the groups above ``most`` rows, or None if there is none. One aggregate over the keys."""
    return known_giants(rows.groupBy(*group).count().where(F.col("count") > most).select(*group))


def known_giants(keys: DataFrame) -> DataFrame | None:
    """``keys`` as the giants, or None if there is none."""
    return materialize(keys, "giants") if keys.take(1) else None


def parted(rows: DataFrame, big: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups and those of giants."""
    return (rows, None) if big is None else (rows.join(big, big.columns, "left_anti"), rows.join(big, big.columns, "left_semi"))


def running(rows: DataFrame, group: list[str], order: list[str], big: DataFrame | None = None, count: str | None = None, last: dict[str, Column] | None = None, bits: int = SEGMENT_BITS) -> DataFrame:
    """``rows`` with running columns of each group in the given order.

    ``count`` names the number of rows up to each; ``last`` gives expressions (of
    the count, too) whose last value that is not null, up to each row, is taken.
    ``big`` has the keys of giant groups (see :func:`giants`), a part of ``group``
    at least. Null keys are a group as others; the order should tell rows apart.
    """
    ordinary, apart = parted(rows, big)
    w = Window.partitionBy(*group).orderBy(*order)
    out = ordinary.withColumn(count, F.row_number().over(w).cast("long")) if count else ordinary
    for name, value in (last or {}).items():
        out = out.withColumn(name, F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out if apart is None else out.unionByName(_segmented(apart, group, order, count, last or {}, bits))


def tasks(rows: DataFrame) -> int:
    """The number of tasks to deal rows to, given, so that few bytes with much work are not put back into one task."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_segment(rows: DataFrame, *keys: str):
    """``rows`` grouped by the keys of segments, dealt to as many tasks as there may be."""
    return rows.repartition(tasks(rows), *keys).groupBy(*keys)


def numbered(rows: DataFrame, group: list[str], order: list[str], bits: int = SEGMENT_BITS) -> DataFrame:
    """``rows`` sorted by range, written, with ``__at``, their place in that order, and ``__segment``, which holds at most 2**bits rows."""
    ordered = rows.repartitionByRange(tasks(rows), *group, *order).sortWithinPartitions(*group, *order)
    at = F.monotonically_increasing_id()
    return materialize(ordered.withColumn("__at", at).withColumn("__segment", F.shiftright("__at", bits)), "segments")


def _segmented(rows: DataFrame, group: list[str], order: list[str], count: str | None, last: dict[str, Column], bits: int) -> DataFrame:
    out = numbered(rows, group, order, bits)
    local = Window.partitionBy("__segment", *group).orderBy("__at")
    if count:
        sizes = out.groupBy("__segment", *group).agg(F.count("*").alias("__n"))
        out = _carried(out.withColumn(count, F.row_number().over(local)), sizes, group, F.sum("__n"))
        out = out.withColumn(count, F.col(count) + F.coalesce("__before", F.lit(0))).drop("__before")
    for name, value in last.items():
        out = out.withColumn("__value", value)
        ends = out.groupBy("__segment", *group).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at"))).alias("__n"))
        here = F.last("__value", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
        out = _carried(out.withColumn(name, here), ends, group, F.last("__n", ignorenulls=True))
        out = out.withColumn(name, F.coalesce(name, "__before")).drop("__value", "__before")
    return out.drop("__at", "__segment")


def _carried(rows: DataFrame, folded: DataFrame, group: list[str], combine: Column) -> DataFrame:
    """``rows`` with ``__before``: the folded segments before theirs in the same group, combined. A group has few folded rows."""
    before = combine.over(Window.partitionBy(*group).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1))
    keys = ["__segment", *group]
    state = folded.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], before.alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(keys)])
    return rows.join(state, same, "left").drop(*[f"__key{i}" for i in range(len(keys))])
