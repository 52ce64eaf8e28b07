"""Streaming forms of the batch operators: windowed detections per unit, sessions, and pairs as they arrive or by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visits(stream: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Detections and mean value per unit and window; rows later than `late` are dropped by the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    d = stream.withWatermark("ts", late).groupBy(w.alias("w"), "s_idx").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return d.select(F.col("w.start").alias("start"), "s_idx", "n", "value")


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "12 hours") -> DataFrame:
    """Sessions of each tag: detections no further apart than the gap."""
    d = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "tagid").agg(F.count("*").alias("n"))
    return d.select("tagid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def pairs(stream: DataFrame, unit_seconds: float = 3600, most: int = 24) -> DataFrame:
    """Release-recapture pairs as detections arrive; the state of a tag is its last detection, and a step back in time makes no pair.

    For detections that come in order. Late ones make no pair here and state
    stays for good; ordered_pairs() waits for them and forgets.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "s_idx"])
        out = []
        for us, unit in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["s_idx"], strict=True):
            if last is not None and us < last[0]:
                continue
            if last is not None:
                out.append((key[0], last[1], int(unit), int(max(1, min(most, round((us - last[0]) / (unit_seconds * 1e6)))))))
            last = (int(us), int(unit))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["tagid", "release", "recapture", "k"])

    d = stream.select("tagid", "ts", "s_idx").groupBy("tagid")
    return d.applyInPandasWithState(step, "tagid long, release int, recapture int, k int", "us long, unit int", "append", "NoTimeout")


def ordered_pairs(stream: DataFrame, late: str = "1 day", forget_days: float = 730.0, unit_seconds: float = 3600, most: int | None = None) -> DataFrame:
    """The pairs of the batch operator from detections in any order: those that come up to `late` behind the newest are put between their neighbours.

    A tag's detections wait in its state until the watermark has passed them, and
    are paired then, in the order of time (ties by unit). What comes after its
    time has passed makes no pair. A tag that is not seen for forget_days is
    forgotten, and its next detection starts anew. State is what waits and one
    detection a tag, so it is bounded by the tags of forget_days and the rows of
    `late`.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_us, last_unit, wait_us, wait_unit = state.get if state.exists else (None, None, [], [])
        waiting = list(zip(wait_us, wait_unit, strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in frames:
                us = rows["ts"].astype("datetime64[us]").astype("int64")
                waiting += [(int(a), int(b)) for a, b in zip(us, rows["s_idx"], strict=True) if a >= mark]
        waiting.sort()
        out = []
        done = sum(us < mark for us, _ in waiting)
        for us, unit in waiting[:done]:
            if last_us is not None:
                k = max(1, round((us - last_us) / (unit_seconds * 1e6)))
                out.append((key[0], last_unit, unit, k if most is None else min(most, k)))
            last_us, last_unit = us, unit
        waiting = waiting[done:]
        end = last_us if not waiting else waiting[0][0]
        wake = None if end is None else (end // 1000 + 1 if waiting else end // 1000 + int(forget_days * 86_400_000))
        if wake is None or not waiting and wake <= mark // 1000:
            if state.exists:
                state.remove()
        else:
            state.update((last_us, last_unit, [a for a, _ in waiting], [b for _, b in waiting]))
            state.setTimeoutTimestamp(max(wake, mark // 1000 + 1))
        yield pd.DataFrame(out, columns=["tagid", "release", "recapture", "k"])

    d = stream.where(F.col("tagid").isNotNull() & F.col("ts").isNotNull() & F.col("s_idx").isNotNull()).select("tagid", "ts", "s_idx").withWatermark("ts", late).groupBy("tagid")
    return d.applyInPandasWithState(step, "tagid long, release int, recapture int, k int", "us long, unit int, wait_us array<long>, wait_unit array<int>", "append", "EventTimeTimeout")
