"""Pages of ordered rows at any depth, and tokens for the page after.

A page near the start is what an ordered limit gives. For a deep one the row at
the offset is found by counting: the rows in equal ranges of the first column
are counted, the range that holds the offset is divided again, and where all of it
has one value the next column goes on. What is sorted is a range of ``SORTED``
rows at most; the page is then what follows that row, a bounded list in each
task. Nulls are where Spark puts them: first in ascending order, last in
descending; NaN has no place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which an ordered limit is taken or a range is sorted; ranges that are counted at a time.
SORTED, RANGES = 10_000, 1024


@dataclass(frozen=True)
class By:
    """A column to order by."""

    name: str
    down: bool = False

    def order(self) -> Column:
        return F.desc(self.name) if self.down else F.asc(self.name)

    def after(self, value) -> Column:
        """Whether a row's value comes after ``value``."""
        c = F.col(self.name)
        if value is None:
            return F.lit(False) if self.down else c.isNotNull()
        later = c < F.lit(value) if self.down else c > F.lit(value)
        return later | c.isNull() if self.down else F.coalesce(later, F.lit(False))


def page_after(rows: DataFrame, by: list[By], token: Row | None, limit: int, inclusive: bool = False) -> DataFrame:
    """The ``limit`` rows after ``token``, the values of the columns of ``by`` of the row before; with ``inclusive`` from it on. No token: from the start.

    The columns should tell rows apart: of rows that equal the token in all of them none follows.
    """
    return _following(rows, by, token, inclusive).orderBy(*[b.order() for b in by]).limit(limit)


def _following(rows: DataFrame, by: list[By], token: Row | None, inclusive: bool) -> DataFrame:
    if token is None:
        return rows
    same = [F.col(b.name).eqNullSafe(F.lit(token[b.name])) for b in by]
    upto = lambda i: reduce(lambda a, c: a & c, same[:i], F.lit(True))
    later = reduce(lambda a, c: a | c, [upto(i) & b.after(token[b.name]) for i, b in enumerate(by)], upto(len(by)) if inclusive else F.lit(False))
    return rows.where(later)


def token_of(page: DataFrame, by: list[By]) -> Row | None:
    """The token of a page's last row, or None of an empty page."""
    last = page.select(*[b.name for b in by]).orderBy(*[By(b.name, not b.down).order() for b in by]).limit(1).collect()
    return last[0] if last else None


def _number(rows: DataFrame, name: str) -> Column | None:
    """The column as a double in the same order (equal doubles are told apart by sorting), or None of a kind that has no such number."""
    kind, c = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, T.NumericType | T.BooleanType):
        return c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else c.cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):  # its first six bytes
        return F.conv(F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 1, 12), 12, "0"), 16, 10).cast("double")
    return None


def page_at(rows: DataFrame, by: list[By], limit: int, offset: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, in order. An offset beyond the rows gives none; ties in all columns are in any order."""
    order = [b.order() for b in by]
    if offset + limit <= SORTED:
        return rows.orderBy(*order).offset(offset).limit(limit)
    some, rest = row_range(rows, by, offset)
    if some is None:
        return rows.limit(0)
    first = some.orderBy(*order).offset(rest).limit(1).select(*[b.name for b in by]).collect()
    if not first:
        return rows.limit(0)
    # among rows that equal the first in all columns some may come before it
    before = rest - (some.count() - _following(some, by, first[0], True).count())
    return page_after(rows, by, first[0], limit + before, inclusive=True).orderBy(*order).offset(before).limit(limit)


def row_range(rows: DataFrame, by: list[By], offset: int) -> tuple[DataFrame | None, int]:
    """The rows of a range that has the row at ``offset``, and its place within; at most ``SORTED`` rows where the columns tell rows apart by numbers."""
    some, rest = rows, offset
    for b in by:
        number = _number(rows, b.name)
        if number is None:
            return some, rest
        value = -number if b.down else number
        while True:
            bounds = some.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), F.count(value).alias("known"), (F.min(b.name) == F.max(b.name)).alias("one")).first()
            if rest >= bounds.n:
                return None, 0
            if bounds.n <= SORTED:
                return some, rest
            nulls = bounds.n - bounds.known
            if not b.down and rest < nulls or b.down and rest >= bounds.known:  # among the nulls, which one value are
                rest -= bounds.known if b.down else 0
                some = some.where(F.col(b.name).isNull())
                break
            rest -= 0 if b.down else nulls
            if bounds.low == bounds.high:
                some = some.where(value.isNotNull())
                if not bounds.one:
                    return some, rest
                break
            width = (bounds.high - bounds.low) / RANGES
            place = F.least(F.floor((value - bounds.low) / width), F.lit(RANGES - 1)).cast("int")
            counts = sorted(some.where(value.isNotNull()).groupBy(place.alias("place")).count().collect())  # RANGES rows
            for here, n in counts:
                if rest < n:
                    break
                rest -= n
            some = some.where(value.isNotNull() & (place == here))
            if len(counts) == 1:  # doubles can't divide it further
                return some, rest
    return some, rest
