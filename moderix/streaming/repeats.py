"""Repeat counts per (sender, target): a batch window and its stateful streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeats(rows: DataFrame, window_us: int) -> DataFrame:
    """rows plus ``repeats``: offensive posts with received - window < time <= received, equal times included. A clean
    post sees the count without adding to it; what is addressed to oneself counts 0."""
    w = W.partitionBy("sender", "target").orderBy("received_us").rangeBetween(-window_us + 1, 0)
    seen = F.coalesce(F.sum(F.col("offensive").cast("long")).over(w), F.lit(0))
    return rows.withColumn("repeats", F.when(F.col("sender") == F.col("target"), 0).otherwise(seen).cast("long"))


def thread_fired(offensive: Column, count: Column, same_target: Column, least: int) -> Column:
    """The thread rule: only an offensive post with enough repeats at the same target."""
    return offensive & (count >= least) & F.coalesce(same_target, F.lit(False))


def streamed_repeats(rows: DataFrame, window_us: int) -> DataFrame:
    """The same counts for a stream of (event_id long, sender long, target long, received_us long, offensive boolean).

    State of a key: the sorted times of its offensive posts within the window. Posts of a micro-batch are taken in order of
    receive time; a post that arrives with an earlier time than ones already seen counts what was received up to its time.
    Keys without a post for a whole window (processing time) are dropped.
    """
    import pandas as pd

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        from bisect import bisect_right, insort

        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["received_us", "event_id"], kind="stable")
        for t in rows.loc[rows.offensive, "received_us"]:
            insort(times, int(t))
        counts = [0 if key[0] == key[1] else bisect_right(times, t) - bisect_right(times, t - window_us) for t in rows.received_us]
        newest = int(rows.received_us.max())
        state.update(([t for t in times if t > newest - 2 * window_us],))
        state.setTimeoutDuration(max(1, window_us // 1000))
        yield pd.DataFrame({"event_id": rows.event_id, "repeats": counts})

    return rows.groupBy("sender", "target").applyInPandasWithState(update, "event_id long, repeats long", "times array<long>", "append", "ProcessingTimeTimeout")
