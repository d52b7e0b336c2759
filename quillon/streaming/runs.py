"""Run events as a stream: envelopes, what is stored, and per-run state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.shared import ship_package

#: Event kinds that carry single tokens; they are never stored (fixed values).
DELTAS = ("delta", "reasoning_delta")


def enveloped(events: DataFrame) -> DataFrame:
    """Events with the fields that every consumer needs: run_id, event, seq, content, at."""
    return events.select(
        F.col("run_id"), F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("content", F.lit("")).alias("content"), F.col("at").cast("timestamp").alias("at")
    )


def to_store(events: DataFrame) -> DataFrame:
    """What is stored: all but token deltas."""
    return events.where(~F.col("event").isin(*DELTAS))


def _passed(rows: pd.DataFrame, mark: int) -> tuple[list[bool], int]:
    keep = []
    for event, seq in zip(rows["event"], rows["seq"], strict=True):
        fresh = event not in DELTAS or seq > mark
        keep.append(fresh)
        if fresh:
            mark = max(mark, int(seq))
    return keep, mark


def without_replays(events: DataFrame) -> DataFrame:
    """Each run's events without token deltas at or below its high-water mark; every other event raises the mark.

    `events` may be a stream, in the order of arrival within a batch; the mark of a run is its state, one number per run, which stays.
    `timeline.changes` keeps whole timelines, and forgets runs that have ended.
    """
    ship_package(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else 0
        for rows in frames:
            rows = rows.sort_values("arrival", kind="stable")
            keep, mark = _passed(rows, mark)
            yield rows[keep]
        state.update((mark,))

    kinds = "arrival long, run_id string, event string, seq long, content string"
    return events.select("arrival", "run_id", "event", "seq", "content").groupBy("run_id").applyInPandasWithState(step, kinds, "mark long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by kind and time window, with a watermark for late ones; `events` may be a stream."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def replayed(events: DataFrame) -> DataFrame:
    """The batch form: text of each run from its stored events and deltas, each sequence number once."""
    first = events.groupBy("run_id", "seq").agg(F.min_by("content", "arrival").alias("content"))
    parts = first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("x"))
    return parts.select("run_id", F.array_join(F.transform("x", lambda s: s["content"]), "").alias("text"))
