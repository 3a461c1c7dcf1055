"""Streams of events: late data, windows, sessions, and the limiter with state. An extension; batch queries share the code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquill.operators.limiter import LIMIT, WINDOW_SECONDS, Held


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; works on a table and, with a watermark, on a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events without a longer gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def admit_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The limiter on a stream of (caller, id, t, n), t in seconds: state is what a caller was admitted in the last window.

    The times carry a watermark of ``late``; requests behind it are left out. When it has passed the last admitted
    request by ``seconds``, the caller's state is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, counts = state.get if state.exists else ([], [])
        held = Held(limit, seconds, list(zip(times, counts, strict=True)))
        rows = pd.concat(frames).sort_values(["t", "id"])
        ok = [held.ask(t, n)[0] for t, n in zip(rows["t"].tolist(), rows["n"].tolist(), strict=True)]
        ends = (held.held[-1][0] + seconds + 1) * 1000 if held.held else 0
        if ends > state.getCurrentWatermarkMs():
            state.update(([t for t, _ in held.held], [n for _, n in held.held]))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"caller": key[0], "id": rows["id"].to_numpy(), "admitted": ok})

    kind = requests.schema["caller"].dataType.simpleString()
    timed = requests.withColumn("__ts", F.timestamp_seconds("t")).withWatermark("__ts", late)
    return timed.groupBy("caller").applyInPandasWithState(step, f"caller {kind}, id long, admitted boolean", "times array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
