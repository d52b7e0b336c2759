"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import checked_broadcast, stored, text_or_empty, unused, word_count

#: Bits of the hash in all, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def row_hash(id_col: str) -> Column:
    """60 bits of the MD5 of the id as text: uniform, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> and target: the weights repeat over the sources by code point, null last; no target
    above `cap` times its source, what is above being shared out by weight among the others.

    Water filling in closed form: with sources ordered by cap / weight, the full ones are a prefix, so one running sum
    finds the level. The windows here see one row per source.
    """
    everything = W.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(everything)).withColumn("w", w)
    most = F.col("source_size") * F.lit(float(cap))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.col("total") - F.col("full_cap")) / (F.col("all_w") - F.col("full_w"))
    return (
        ranked.withColumn("most", most)
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("full_cap", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("full_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(whole))
        .select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: Sequence[Column] = ()
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, and the columns of `carry`.

    A source whose target is k whole passes and a rest gives every document k times, and once more those whose hash is
    below the source's threshold. Histograms of words by source and hash bucket find the threshold: the bucket where
    the running sum passes the rest is refined by the next bits, and nothing else, until it holds a single hash value;
    that value is taken if this brings the sum nearer. No rows are sorted; the documents' texts are read once.

    Null text has size 0 and is taken with 0 words; null sources form one source, the last; rows with one id share a
    hash and so go together; an empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), row_hash(id_col).alias("h"), *carry))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    bounds = stored(
        source_targets(sizes, weights, share, cap)
        .withColumn("passes", whole)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("everything"), F.lit(False).alias("done"))
    )
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        bounds = stored(_refined(rows, bounds, shift))
        if bounds.where("NOT done").limit(1).count() == 0:
            break
    # `prefix` is now a whole hash value for every source with a boundary; `last` is its words.
    near = (F.col("below") + F.col("last") - F.col("rest")) < (F.col("rest") - F.col("below"))
    bounds = bounds.withColumn("near", near)
    more = F.col("everything") | (F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & F.col("near"))
    kept = [c for c in rows.columns if c not in ("id", "source", "size", "h")]
    other = checked_broadcast(bounds.withColumnRenamed("source", "of"))
    return rows.join(other, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))).cast("long").alias("taken"),
        (F.col("passes") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("long").alias("copies"),
        *kept,
    )


def _refined(rows: DataFrame, bounds: DataFrame, shift: int) -> DataFrame:
    """`bounds` with each open source's boundary bucket refined by the next LEVEL_BITS bits of the hash."""
    open_ = checked_broadcast(bounds.where("NOT done").select(F.col("source").alias("of"), "prefix", "below", "rest"))
    bucket = F.shiftright("h", shift)
    hist = (
        rows.join(open_, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        .groupBy("of", "below", "rest", bucket.alias("bucket"))
        .agg(F.sum("size").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    )
    # At most 2**LEVEL_BITS buckets a source.
    running = F.sum("n").over(W.partitionBy("of").orderBy("bucket"))
    hit = (
        hist.withColumn("upto", F.col("below") + running)
        .where(F.col("upto") > F.col("rest"))
        .groupBy("of")
        .agg(F.min(F.struct("bucket", "upto", "n", "low", "high")).alias("b"))
        .select("of", "b.*")
    )
    single = F.col("low") == F.col("high")
    merged = bounds.join(hit, F.col("source").eqNullSafe(F.col("of")), "left")
    if "last" not in bounds.columns:
        merged = merged.withColumn("last", F.lit(None).cast("long"))
    fresh, found = ~F.col("done"), F.col("bucket").isNotNull()
    return merged.select(
        "source", "source_size", "target", "passes", "rest",
        F.when(fresh & found, F.when(single, F.col("low")).otherwise(F.col("bucket"))).otherwise(F.col("prefix")).alias("prefix"),
        F.when(fresh & found, F.col("upto") - F.col("n")).otherwise(F.col("below")).alias("below"),
        F.when(fresh & ~found, F.lit(True)).otherwise(F.col("everything")).alias("everything"),
        F.when(fresh, ~found | single).otherwise(F.col("done")).alias("done"),
        F.when(fresh & found, F.col("n")).otherwise(F.col("last")).alias("last"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix_sources` takes it, with all its columns, whatever their names.

    Null and empty texts have no words, and are taken as often as their source's whole passes and their hash say. Rows
    that repeat id and text are each taken alike; an empty table stays empty."""
    carry = [F.sha2(text_or_empty(text_col), 256).alias("d")]
    copies = mix_sources(docs, weights, share, cap, id_col, source_col, text_col, carry).select(F.col(id_col).alias("i"), "d", "copies").where("copies > 0").distinct()
    digest, times, copy = (unused(docs, c) for c in ("text_digest", "mix_copies", "mix_copy"))
    named = docs.withColumns({digest: F.sha2(text_or_empty(text_col), 256)})
    copies = copies.withColumnRenamed("copies", times)
    joined = named.join(copies, named[id_col].eqNullSafe(copies["i"]) & (named[digest] == copies["d"]))
    return joined.select(*[named[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies[times].cast("int"))).alias(copy)).drop(copy)
