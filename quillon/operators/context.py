"""Conversation context: turns, budgets, merging of consecutive messages, repair of tool-call pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turn_numbers(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Each user message starts a group; what comes before the first is group 0."""
    return rows.withColumn("group", F.sum((F.col("role") == "user").cast("int")).over(W.partitionBy(key).orderBy(pos)))


def last_turns(rows: DataFrame, key: str, pos: str, n: int) -> DataFrame:
    """Rows of the last n groups."""
    grouped = turn_numbers(rows, key, pos)
    return grouped.withColumn("_r", F.dense_rank().over(W.partitionBy(key).orderBy(F.desc("group")))).where(F.col("_r") <= n).drop("_r")


def within_budget(rows: DataFrame, key: str, pos: str, cost: Column, budget: int, protect: int = 0) -> DataFrame:
    """The newest rows whose running cost fits the budget; the newest `protect` rows always stay."""
    newest = W.partitionBy(key).orderBy(F.desc(pos))
    marked = rows.withColumn("_cost", F.sum(cost).over(newest.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(newest))
    return marked.where((F.col("_cost") <= budget) | (F.col("_n") <= protect)).drop("_cost", "_n")


def tail_with_cut(rows: DataFrame, key: str, pos: str, text: str, budget: int) -> DataFrame:
    """The newest rows within a budget of characters, the one on the edge cut to what is left."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(key).orderBy(F.desc(pos)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("_before", before).where(F.col("_before") < budget)
    return marked.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def merged_messages(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of messages with one role joined by newlines: key, role, first position, text."""
    order = W.partitionBy(key).orderBy(pos)
    new = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    islands = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    parts = islands.groupBy(key, "_run", "role").agg(F.min(pos).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce("text", F.lit("")).alias("t")))).alias("x"))
    return parts.select(key, "role", "first", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))


def repaired_calls(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Tool calls that have a response, and responses whose call came before. rows: key, pos, call_id, kind (call or
    response); each call keeps its first response after it."""
    calls = rows.where("kind = 'call'").groupBy(key, "call_id").agg(F.min(pos).alias("called"))
    answers = rows.where("kind = 'response'").join(calls, [key, "call_id"]).where(F.col(pos) > F.col("called")).groupBy(key, "call_id", "called").agg(F.min(pos).alias("answered"))
    return answers


def folded(deltas: DataFrame, key: str, pos: str) -> DataFrame:
    """Streamed text per key: a full message resets the buffer, deltas after it append. deltas: kind, text."""
    reset = F.max(F.when(F.col("kind") == "message", F.col(pos))).over(W.partitionBy(key))
    kept = deltas.withColumn("_reset", reset).where(F.col("_reset").isNull() | (F.col(pos) >= F.col("_reset")))
    parts = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t")))).alias("x"))
    return parts.select(key, F.array_join(F.transform("x", lambda s: s["t"]), "").alias("text"))
