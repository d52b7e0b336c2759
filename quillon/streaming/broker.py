"""Runs for subscribers: what is stored first, then what is live, each stored event once although it comes both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.streaming.runs import DELTAS


def subscription(stored: DataFrame, live: DataFrame, keep: str = "10 minutes") -> DataFrame:
    """The events that a subscriber gets: run_id, event, event_id, seq, source ("stored" or "live"), received, content.

    Both are streams: `stored` is the event table read from its start (run_id, event, event_id, seq_no, content), `live` what runs publish (run_id, event,
    event_id, stream_seq, content), in which stored events have their event_id too and single tokens have none. Numbers of the two are of different
    kinds: a stored event has its place in the session's table, a token its place in the run's own queue, so neither is compared with the other. A
    stored event that comes both ways is the same event by its id and passes once; a token passes by run and place. What was received stays known
    for `keep`, by the time of receipt, so history is never too late and state is bounded. Events without a run are left out."""
    one = lambda df, seq, source: df.select("run_id", F.coalesce("event", F.lit("message")).alias("event"), "event_id", F.col(seq).cast("long").alias("seq"), F.lit(source).alias("source"), "content")
    both = one(stored.where(~F.col("event").isin(*DELTAS)), "seq_no", "stored").unionByName(one(live, "stream_seq", "live")).where("run_id IS NOT NULL")
    key = F.coalesce(F.concat(F.lit("e:"), "event_id"), F.concat(F.lit("t:"), "event", F.lit(":"), F.coalesce(F.col("seq").cast("string"), F.lit(""))))
    timed = both.withColumn("received", F.current_timestamp()).withColumn("key", key).withWatermark("received", keep)
    return timed.dropDuplicatesWithinWatermark(["run_id", "key"]).drop("key")


def in_order(batch: DataFrame) -> DataFrame:
    """A batch as it is delivered, by run: stored events by their number, then live ones by theirs."""
    return batch.sortWithinPartitions("run_id", F.col("source") != "stored", "seq")
