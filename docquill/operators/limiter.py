"""A sliding-window limiter: which requests are admitted.

Callers are folded one after the other. The requests of a giant caller are
segments that start on a guess: each first runs through the ``WARM`` requests
before it, from an empty window, and two runs over the same requests soon hold
the same ones. A segment whose window is not what the one before it left is run
again from that, until all meet; so the result is that of one fold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquill.operators.segments import SEGMENT_BITS, by_segment, parted, running
from docquill.scratch import materialize

#: Files an anonymous caller may send in an hour (fixed values).
LIMIT, WINDOW_SECONDS = 50, 3600
#: Requests that a segment runs through before its own; windows in a stretch of time that one task sums.
WARM, STRETCH = 1024, 8


class Held:
    """What was admitted in the last ``seconds``."""

    def __init__(self, limit: int, seconds: int, held: list | None = None) -> None:
        self.limit, self.seconds = limit, seconds
        self.held = deque(held or [])
        self.total = sum(n for _, n in self.held)

    def expire(self, t: int) -> None:
        while self.held and self.held[0][0] < t - self.seconds:
            self.total -= self.held.popleft()[1]

    def ask(self, t: int, n: int) -> tuple[bool, int]:
        """Whether the request is admitted, and the seconds until it may be tried again."""
        self.expire(t)
        if self.total + n > self.limit:
            return False, max(0, int(self.held[0][0] + self.seconds - t)) if self.held else 0
        if n:
            self.held.append((t, n))
            self.total += n
        return True, 0


def demand(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``requests`` (caller, t, n) with ``asked``: files asked for in the window up to each request.

    A caller's time is cut in stretches of ``STRETCH`` windows; requests in the last window of one are also seen by the next.
    """
    width = seconds * STRETCH
    stretch = F.floor(F.col("t") / width).cast("long")
    seen = F.when(F.pmod("t", F.lit(width)) >= width - seconds, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    window = Window.partitionBy("caller", "__stretch").orderBy("t").rangeBetween(-seconds, 0)
    rows = requests.withColumn("__own", stretch).withColumn("__stretch", F.explode(seen))
    return rows.withColumn("asked", F.sum("n").over(window)).where("__own = __stretch").drop("__own", "__stretch")


def admit(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, big: DataFrame | None = None, bits: int = SEGMENT_BITS, warm: int = WARM) -> DataFrame:
    """(caller, id, t, n, admitted, retry_after) of (caller, id, t, n), by caller in the order of t and id.

    A request is admitted if the files admitted in the last ``seconds`` and its
    own are within ``limit``; only admitted ones count later. ``big`` has the
    callers with too many requests for a task (:func:`segments.giants`).
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, held = object(), Held(limit, seconds)
        for frame in frames:
            answers = []
            for c, t, n in zip(frame["caller"].tolist(), frame["t"].tolist(), frame["n"].tolist(), strict=True):
                if c != caller:
                    caller, held = c, Held(limit, seconds)
                answers.append(held.ask(t, n))
            yield frame.assign(admitted=[a for a, _ in answers], retry_after=[w for _, w in answers])

    ordinary, apart = parted(requests.select("caller", "id", "t", "n"), big)
    ordered = ordinary.repartition("caller").sortWithinPartitions("caller", "t", "id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    folded = ordered.mapInPandas(fold, f"{fields}, admitted boolean, retry_after long")
    return folded if apart is None else folded.unionByName(_admit_giants(apart, limit, seconds, bits, min(warm, 1 << bits), f"{fields}, admitted boolean, retry_after long"))


def _admit_giants(requests: DataFrame, limit: int, seconds: int, bits: int, warm: int, fields: str) -> DataFrame:
    kind = requests.schema["caller"].dataType.simpleString()
    placed = running(requests, ["caller"], ["t", "id"], requests.select("caller").distinct(), "__n", bits=bits)
    rows = materialize(placed.withColumn("__n", F.col("__n") - 1).withColumn("segment", F.shiftright("__n", bits)), "placed-requests")
    windows = "array<struct<t: long, n: long>>"
    states = f"caller {kind}, segment long, first long, entry {windows}, exit {windows}"
    listed = lambda held: [{"t": int(t), "n": int(n)} for t, n in held.held]

    def run(frame: pd.DataFrame, held: Held, own: int) -> pd.DataFrame:
        """One segment after the requests of the one before it that it has in view."""
        frame = frame.sort_values("__n")
        entry, first = None, None
        for segment, t, n in zip(frame["own"].tolist(), frame["t"].tolist(), frame["n"].tolist(), strict=True):
            if entry is None and segment == own:
                held.expire(t)
                entry, first = listed(held), t
            held.ask(t, n)
        return pd.DataFrame({"caller": [frame["caller"].iloc[0]], "segment": [own], "first": [first], "entry": [entry], "exit": [listed(held)]})

    def guessed(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame, Held(limit, seconds), int(frame["segment"].iloc[0]))

    def known(frame: pd.DataFrame) -> pd.DataFrame:
        return run(frame, Held(limit, seconds, [(w["t"], w["n"]) for w in frame["entry"].iloc[0]]), int(frame["segment"].iloc[0]))

    def answered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__n")
        held = Held(limit, seconds, [(w["t"], w["n"]) for w in frame["entry"].iloc[0]])
        answers = [held.ask(t, n) for t, n in zip(frame["t"].tolist(), frame["n"].tolist(), strict=True)]
        return frame[["caller", "id", "t", "n"]].assign(admitted=[a for a, _ in answers], retry_after=[w for _, w in answers])

    # the last requests of a segment are also seen by the next
    seen = F.when(F.col("__n") % (1 << bits) >= (1 << bits) - warm, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    view = rows.withColumnRenamed("segment", "own").withColumn("segment", F.explode(seen))
    last = rows.groupBy("caller").agg(F.max("segment").alias("last"))
    view = view.join(last, "caller").where("segment <= last").drop("last")
    found = materialize(by_segment(view, "caller", "segment").applyInPandas(guessed, states), "limiter-states")
    while True:
        before = found.select("caller", (F.col("segment") + 1).alias("segment"), F.col("exit").alias("left"))
        still = F.filter(F.coalesce("left", F.array().cast(windows)), lambda w: w["t"] >= F.col("first") - seconds)
        apart = found.join(before, ["caller", "segment"], "left").withColumn("left", still).where(F.col("left") != F.col("entry")).select("caller", "segment", F.col("left").alias("entry"))
        if not apart.take(1):
            break
        apart = materialize(apart, "limiter-entries")
        again = by_segment(rows.withColumn("own", F.col("segment")).join(apart, ["caller", "segment"]), "caller", "segment").applyInPandas(known, states)
        found = materialize(found.join(apart, ["caller", "segment"], "left_anti").unionByName(again), "limiter-states")
    return by_segment(rows.join(found.select("caller", "segment", "entry"), ["caller", "segment"]), "caller", "segment").applyInPandas(answered, fields)
