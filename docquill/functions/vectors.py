"""Vector scalars in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where the lengths differ, a vector is zero or null."""
    both = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both), F.lit(0.0))


def cosine_clipped(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def cosine_strict(a: Column, b: Column) -> Column:
    """Fails where the lengths differ."""
    return F.when(F.size(a) == F.size(b), cosine(a, b)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def parse_vector(c: Column) -> Column:
    """The doubles of a JSON array; null where it is malformed."""
    return F.from_json(c, "array<double>")
