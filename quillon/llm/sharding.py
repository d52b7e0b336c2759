"""Reproducible shuffling into shards by a Feistel permutation of global row numbers; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored, text_or_empty

#: The prime of the round function, 2**31 - 1, and the rounds' key pairs (any numbers below the prime).
PRIME = 2_147_483_647
ROUNDS = [(1_640_531_527 + 97_003 * k, 362_436_069 + 7_919 * k * k) for k in range(8)]


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> tuple[DataFrame, int]:
    """(`rows` with their global number from 0 in `order`, how many there are).

    A range exchange sorts; each row's place in its partition comes from monotonically_increasing_id, and the
    partitions' offsets from a running sum over one row per partition, so no task sees more than its own range. The
    row's first place breaks ties, so equal keys are dealt over partitions too.
    """
    spark = rows.sparkSession
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*[F.asc_nulls_last(c) for c in order], "_tie")
    placed = stored(sorted_.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # one row per partition
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((p, total))
        total += c
    table = spark.createDataFrame(offsets or [(0, 0)], "p long, offset long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(table), part == F.col("p")).withColumn(name, F.col("offset") + place).drop("_at", "p", "offset"), total


def permuted(number: Column, total: int) -> Column:
    """A pseudo-random permutation of 0 .. total-1, computable for each number alone.

    A Feistel network on pairs (left < a, right < b) with a * b just above `total` permutes 0 .. a*b-1; a result that
    is not below `total` is permuted again (cycle walking), at most a*b - total times, and that happens to about one
    number in sqrt(total).
    """
    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    b = max(1, -(-total // a))

    def mixed(x: Column, keys: Column) -> Column:
        y = (x + keys["add"]) % PRIME
        return (y * y % PRIME + keys["mul"] * (x % PRIME)) % PRIME

    schedule = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).cast("long").alias("add"), F.lit(m).cast("long").alias("mul")) for i, (k, m) in enumerate(ROUNDS)])

    def network(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r"))

        def step(acc: Column, keys: Column) -> Column:
            even = keys["i"] % 2 == 0
            return F.struct(
                F.when(even, (acc["l"] + mixed(acc["r"], keys)) % a).otherwise(acc["l"]).cast("long").alias("l"),
                F.when(even, acc["r"]).otherwise((acc["r"] + mixed(acc["l"], keys)) % b).cast("long").alias("r"),
            )

        return F.aggregate(schedule, start, step, lambda acc: acc["l"] * F.lit(b) + acc["r"])

    first = network(number)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, a * b - total))), first, lambda acc, _: F.when(acc < total, acc).otherwise(network(acc)))
    return F.when(first < total, first).otherwise(walk)


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard. The law is `rows`.

    Documents are numbered by id (null ids last; equal ids by checksum, then size, then place), the number is permuted,
    and the permuted number modulo `shards` is the shard, divided by it the slot: counts differ by one at most and
    slots have no gaps. Null text: 8 bytes of size, checksum 0, as for an empty text. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows, total = numbered(narrow, ["id", "text_crc32", "size"])
    at = rows.withColumn("at", permuted(F.col("n"), total))
    return at.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("at") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("at"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
