"""Reliability of sessions from their event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import percentiles


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b, by the microsecond."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def turns(log: DataFrame, end_type: str) -> DataFrame:
    """A row per ended turn: session_id, turn, status (the first end's), started, ended, duration. log: session_id,
    turn, seq_no, ts, event_type, status."""
    end = F.col("event_type") == end_type
    found = log.groupBy("session_id", "turn").agg(
        F.min_by("ts", "seq_no").alias("started"),
        F.min_by(F.when(end, F.col("ts")), F.when(end, F.col("seq_no"))).alias("ended"),
        F.min_by(F.when(end, F.col("status")), F.when(end, F.col("seq_no"))).alias("status"),
    )
    return found.where("ended IS NOT NULL").withColumn("duration", seconds_between(F.col("started"), F.col("ended")))


def status_counts(ended: DataFrame, by: list[Column]) -> DataFrame:
    return ended.groupBy(*by, F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("turns"))


def rates(ended: DataFrame) -> DataFrame:
    """Totals, completion and cancellation rates (null of nothing), and duration percentiles."""
    n = F.count("*")
    counts = ended.agg(
        n.alias("turns"),
        F.try_divide(F.count_if(F.col("status") == "completed"), n).alias("completed_rate"),
        F.try_divide(F.count_if(F.col("status") == "cancelled"), n).alias("cancelled_rate"),
    )
    return counts.join(percentiles(ended, [], {"duration_p50": ("duration", 0.5, "linear"), "duration_p95": ("duration", 0.95, "linear")}), how="left").fillna(0.0, ["duration_p50", "duration_p95"])


def steps(events: DataFrame) -> DataFrame:
    """One row per step of a turn: its stage from the first event, whether any failed, the first error, and the last
    times seen. events: session_id, turn, seq_no, stage, step_key, status, content, created, completed."""
    failed = F.col("status") == "failed"
    error = failed & (F.coalesce("content", F.lit("")) != "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq_no")))
    kept = events.where("coalesce(stage, '') <> '' AND coalesce(step_key, '') <> ''")
    return kept.groupBy("session_id", "turn", "step_key").agg(
        F.min_by("stage", "seq_no").alias("stage"),
        F.bool_or(F.coalesce(failed, F.lit(False))).alias("failed"),
        F.min_by(F.when(error, F.col("content")), F.when(error, F.col("seq_no"))).alias("error"),
        last("created").alias("created"),
        last("completed").alias("completed"),
        F.min("created").alias("first_created"),
        F.min("seq_no").alias("first_seq"),
    )


def stage_stats(step_rows: DataFrame) -> DataFrame:
    """Per stage: calls, failures, failure rate, duration percentiles."""
    took = seconds_between(F.col("created"), F.col("completed"))
    true = seconds_between(F.col("first_created"), F.col("completed"))
    counts = step_rows.groupBy("stage").agg(
        F.count("*").alias("calls"),
        F.count_if("failed").alias("failed"),
        F.avg(F.col("failed").cast("int")).alias("failure_rate"),
    )
    timed = step_rows.select("stage", took.alias("took"), true.alias("true"))
    return counts.join(percentiles(timed, ["stage"], {"duration_p50": ("took", 0.5, "linear"), "duration_p95": ("took", 0.95, "linear"), "true_p95": ("true", 0.95, "linear")}), "stage")


def top_errors(step_rows: DataFrame, n: int = 3, most: int = 200) -> DataFrame:
    """The commonest error texts of each stage, cut; the first seen of equally common ones."""
    counts = step_rows.where("failed AND error IS NOT NULL").groupBy("stage", F.substring("error", 1, most).alias("error")).agg(F.count("*").alias("times"), F.min(F.struct("session_id", "turn", "first_seq")).alias("first"))
    rank = F.row_number().over(W.partitionBy("stage").orderBy(F.desc("times"), "first"))
    return counts.withColumn("place", rank).where(F.col("place") <= n).select("stage", "place", "error", "times")


def overall_success(stages: DataFrame) -> DataFrame:
    return stages.agg((1 - F.try_divide(F.sum("failed"), F.sum("calls"))).alias("success"))


def retried(failed_turns: DataFrame, messages: DataFrame, within: int = 60) -> DataFrame:
    """(session_id, turn, other): user messages' other turns within so many seconds after a turn failed.

    The join is on session and a bucket of time as well as the interval, so a long session is spread over many keys.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = within * 1_000_000
    ends = failed_turns.select("session_id", "turn", at("ended").alias("e")).withColumn("bucket", F.explode(F.array(F.floor(F.col("e") / width), F.floor(F.col("e") / width) + 1)))
    said = messages.select("session_id", F.col("turn").alias("other"), at("ts").alias("m")).withColumn("bucket", F.floor(F.col("m") / width))
    return ends.join(said, ["session_id", "bucket"]).where((F.col("turn") != F.col("other")) & (F.col("m") > F.col("e")) & (F.col("m") <= F.col("e") + width)).select("session_id", "turn", "other").distinct()


def call_stats(calls: DataFrame) -> DataFrame:
    """Per operation: calls, retry rate, duration figures, token sums under either name. calls: operation, attempts,
    duration_ms, prompt_tokens, input_tokens, completion_tokens, output_tokens."""
    tokens = lambda a, b: F.sum(F.coalesce(F.when(F.col(a) != 0, F.col(a)), F.col(b), F.lit(0)))
    counts = calls.groupBy("operation").agg(
        F.count("*").alias("calls"),
        F.avg((F.col("attempts") > 1).cast("int")).alias("retry_rate"),
        F.max("duration_ms").alias("longest"),
        tokens("prompt_tokens", "input_tokens").alias("input"),
        tokens("completion_tokens", "output_tokens").alias("output"),
    )
    return counts.join(percentiles(calls, ["operation"], {"p50": ("duration_ms", 0.5, "linear"), "p95": ("duration_ms", 0.95, "linear")}), "operation")


def attempt_success(attempts: DataFrame, papers: DataFrame) -> DataFrame:
    """Over distinct attempted (session, paper): how many, and the share that the workspace has with full text."""
    each = attempts.select("session_id", "paper_id").distinct()
    got = papers.select("session_id", "paper_id", F.lit(1).alias("ok")).distinct()
    return each.join(got, ["session_id", "paper_id"], "left").agg(F.count("*").alias("attempts"), F.avg(F.coalesce("ok", F.lit(0))).alias("success"))


def parsed_calls(lines: DataFrame, marker: str) -> DataFrame:
    """Log lines that hold the marker: the JSON after `ctx=` as variant (null if it doesn't parse) and the time."""
    kept = lines.where(F.col("line").contains(marker))
    context = F.regexp_extract("line", r"ctx=(.*)$", 1)
    return kept.select(F.try_parse_json(F.when(context != "", context)).alias("ctx"), F.regexp_extract("line", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1).alias("time"))


def first_token_delay(posts: DataFrame, events: DataFrame, least: float = 0.001) -> DataFrame:
    """Seconds from each post to the first content after it in its turn."""
    first = events.groupBy("session_id", "turn").agg(F.min("ts").alias("first"))
    return posts.join(first, ["session_id", "turn"]).select("session_id", "turn", F.greatest(seconds_between(F.col("ts"), F.col("first")), F.lit(least)).alias("delay"))
