"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each source has a token constraint: the words that the mix takes from it. Of all
document rates between 0 and ``cap`` that meet it, entropy balancing takes those
of least relative entropy to a rate of one, which are ``min(cap, exp(l * size))``
for one multiplier ``l`` a source. Newton iterations find the roots of the dual's
gradient for all sources at once: each sums value and slope over the table of
(source, size, number of documents), a pre-aggregate that is exact because
documents of one size have one rate. Bisection takes over where a step leaves
the bracket.

Rates become copies by systematic rounding: within a source, sizes from the
largest down, whole copies follow the running sum of the fractions, so the words
taken stay within half the largest document of the target; a few largest-fit
corrections close most of the rest. Of the documents of one size those with the
smallest hashes get the additional copy. The hash up to which they do is found on
narrow rows: counts by the hash's leading bits name the sub-cell it lies in, and
only that sub-cell is ranked, so that a size that a third of all rows share is
never ranked in one task. Copies are then decided where the documents are read;
no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquill.llm.common import WORD, text_of
from docquill.scratch import materialize

#: Weights of the sources in order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2

#: Rows in a sub-cell that is ranked by one sort, most bits that name a sub-cell, and cells that are broadcast.
CELL_ROWS, MOST_BITS, BROADCAST_CELLS = 512, 16, 500_000


#: Sorts as the source by code point, null last, and joins without null-safe comparisons.
def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def words_in(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size); sources are :func:`source_key` values.

    Sources in order get the weights in turn. They share ``share`` times all
    words by weight; a target stops at ``cap`` times its source's size, and the
    excess is shared again by weight among the others until none is above. The
    level at which this ends is found in one pass, as sources fill up in the
    order of ``cap * size / weight``.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # from here on one row a source: their order as a whole is part of the task
    place = F.row_number().over(Window.orderBy("source"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights))
    t = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    every = Window.partitionBy(F.lit(0))
    filling = every.orderBy(F.col("most") / F.col("weight"), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    full, taken = (F.coalesce(F.sum(c).over(filling), F.lit(0.0)) for c in ("most", "weight"))
    t = t.withColumn("level", (F.sum("source_size").over(every) * float(share) - full) / (F.sum("weight").over(every) - taken))
    # the first source that its level does not fill sets the level of all that follow
    holds = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("at"), F.col("source"), F.col("level").alias("level")))
    level = F.min(holds).over(every)["level"]
    return t.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("most")), F.col("most"))).select("source", "source_size", "target")


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float = CAP, rounds: int = 15, steps: int = 3, tolerance: float = 1e-11) -> DataFrame:
    """(source, source_size, target, scale, tilt) that meet the targets; ``cells``: (source, size, n).

    A document's rate is ``min(cap, exp(tilt * size / scale))``. Each of up to
    ``rounds`` jobs makes ``steps`` Newton steps for all sources; they end once
    every source is within ``tolerance`` of its target, relatively. Sources
    whose target is all they can give need no tilt.
    """
    scale = cells.groupBy("source").agg(F.greatest(F.sum(F.col("size") * F.col("n")) / F.sum("n"), F.lit(1.0)).alias("scale"))
    full = F.col("target") >= F.col("source_size") * float(cap)
    state = targets.join(scale, "source").select(
        "source", "source_size", "target", "scale", F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.when(full, 0.0).otherwise(1.0).alias("off")
    )
    for _ in range(rounds):
        for _ in range(steps):
            x = F.col("size") / F.col("scale")
            rate = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
            sums = cells.join(state, "source").groupBy(*state.columns).agg(
                F.sum(F.least(rate, F.lit(float(cap))) * F.col("size") * F.col("n")).alias("value"),
                F.sum(F.when(rate < cap, rate * F.col("size") * x * F.col("n")).otherwise(0.0)).alias("slope"),
            )
            over = F.col("value") - F.col("target")
            sums = sums.select(
                "source", "source_size", "target", "scale", "tilt",
                F.when(over <= 0, F.col("tilt")).otherwise(F.col("low")).alias("low"),
                F.when(over > 0, F.col("tilt")).otherwise(F.col("high")).alias("high"),
                F.when(full, 0.0).otherwise(F.abs(over) / F.greatest("target", F.lit(1.0))).alias("off"),
                (F.col("tilt") - F.try_divide(over, F.col("slope"))).alias("newton"),
            )
            inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
            step = F.when(F.col("off") <= tolerance, F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
            state = sums.withColumn("tilt", step).drop("newton")
        state = materialize(state, "tilts")
        if state.where(F.col("off") > tolerance).isEmpty():
            break
    return state.select("source", "source_size", "target", "scale", F.round("tilt", 9).alias("tilt"))


def plan_copies(cells: DataFrame, targets: DataFrame, cap: int = CAP, corrections: int = 4) -> DataFrame:
    """``cells`` with source_size, target, rate, whole and more: each of the n documents gets ``whole`` copies, ``more`` of them one in addition."""
    c = cells.join(solve_tilts(cells, targets, float(cap)), "source")
    tilted = F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(float(cap)))
    c = c.withColumn("rate", F.when(F.col("target") >= F.col("source_size") * float(cap), F.lit(float(cap))).otherwise(tilted))
    c = c.withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.round((F.col("rate") - F.col("whole")) * F.col("n"), 9))
    by_source = Window.partitionBy("source")  # a row for each size that occurs, not for each document
    upto = F.sum("part").over(by_source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("upto", upto).withColumn("more", F.least((F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5)).cast("long"), F.col("n")))
    for _ in range(corrections):  # add or take the one copy that fits the rest best
        rest = F.col("target") - F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("more"))).over(by_source)
        c = c.withColumn("rest", rest)
        can = F.when(F.col("rest") > 0, (F.col("more") < F.col("n")) & (F.col("whole") < cap)).otherwise(F.col("more") > 0)
        fit = F.when(can & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("rest")), F.struct(F.abs(F.col("size") - F.abs("rest")).alias("gap"), F.col("size").alias("size")))
        c = c.withColumn("best", F.min(fit).over(by_source)["size"])
        c = c.withColumn("more", F.col("more") + F.when(F.col("size") == F.col("best"), F.signum("rest").cast("long")).otherwise(0))
    return materialize(c.select("source", "size", "n", "source_size", "target", "rate", "whole", "more"), "copies")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None,
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """``docs`` with the struct ``mix``: size, source_size, target, rate and copies (0 to ``cap``).

    Sizes are words, unless ``size_col`` has them already; null text has none. A
    null source is a source of its own, the last in order. Documents without
    words have the rate one. A column of ``docs`` that is named mix is replaced;
    other names do not clash. Copies depend on ids, texts (where sizes are
    counted here), sources and sizes only, so reruns agree; rows that are equal in
    all of these are treated alike. Texts of any length are counted whole; an
    empty table gives an empty result.
    """
    size = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)) if size_col else words_in(text_of(text_col))
    told = [F.col(f"`{c}`") for c in ([id_col] if size_col else [id_col, text_col])]
    source = source_key(F.col(f"`{source_col}`"))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"]).alias("row"), source.alias("source"), size.alias("size"), F.xxhash64(*told, source).alias("hash"))
    narrow = materialize(sized.select("source", "size", "hash"), "sizes")
    cells = materialize(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = source_targets(cells.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    plan = plan_copies(cells, targets, cap)
    few = plan.count() <= BROADCAST_CELLS  # a row for each size that occurs in a source
    small = F.broadcast if few else (lambda df: df)
    # a cell in which some get a copy more than others: its n rows by the leading bits of the hash
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL_ROWS)))).cast("int")
    divided = plan.where("more > 0 AND more < n").select("source", "size", "more", bits.alias("bits"))
    upper = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(1 << 63))), 1)  # in the order of the hash, but never negative
    sub = F.call_function("shiftright", upper, F.lit(63) - F.col("bits")).alias("sub")
    dealt = narrow.join(small(divided), ["source", "size"]).select("source", "size", "more", "hash", sub)
    counts = dealt.groupBy("source", "size", "more", "sub").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("sub"))
    last = counts.withColumn("upto", upto).where("upto >= more AND upto - n < more").select("source", "size", F.col("sub").alias("at"), (F.col("more") - F.col("upto") + F.col("n")).alias("need"))
    last = materialize(last, "sub-cells")
    found = dealt.join(small(last), ["source", "size"]).where("sub = at")
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("hash"))
    limits = materialize(found.withColumn("rank", rank).where("rank = need").select("source", "size", F.col("hash").alias("limit")), "limits")
    every = F.when(F.col("more") > 0, F.lit((1 << 63) - 1))
    plan = plan.join(limits, ["source", "size"], "left").select(F.col("source").alias("s"), F.col("size").alias("z"), F.struct("source_size", "target", "rate", "whole", F.coalesce("limit", every).alias("limit")).alias("cell"))
    plan = materialize(plan, "plan")
    met = sized.join(small(plan), (F.col("source") == F.col("s")) & (F.col("size") == F.col("z")))
    cell = F.col("cell")
    copies = cell["whole"] + F.coalesce((F.col("hash") <= cell["limit"]).cast("int"), F.lit(0))
    return met.select("row.*", F.struct("size", cell["source_size"].alias("source_size"), cell["target"].alias("target"), cell["rate"].alias("rate"), copies.alias("copies")).alias("mix"))
