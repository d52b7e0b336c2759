"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checked_broadcast, fits_broadcast, stored, text_or_empty, unused

#: Bytes of the prefix that the second refinement hashes.
PREFIX = 64


def _measures(text: Column) -> list[Column]:
    return [F.octet_length(text).cast("long").alias("len"), F.xxhash64(F.substring(F.encode(text, "UTF-8"), 1, PREFIX)).alias("prefix")]


def ambiguous(rows: DataFrame) -> DataFrame:
    """(len, prefix) that two rows or more share: lengths are counted first, then prefixes of the rows whose length another has. Counts are
    combined in each task before they move, so rows of one length or prefix never meet in one task."""
    lengths = rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    return stored(narrowed(rows, lengths, ["len"]).groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("len", "prefix"))


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among `keys`, if these fit a broadcast; else all rows, as what comes after settles the others too, and moving every
    row to meet so many keys would cost more than it saves."""
    return rows.join(F.broadcast(keys), on, "left_semi") if fits_broadcast(keys) else rows


def groups_of_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): `rows` has one narrow row per document (id, row, len, prefix, digest); `groups` one row per
    text found twice or more (digest, keep, size).

    A document whose length, or whose length and prefix, no other has isn't grouped by its full hash. No text is ever shuffled, and groups are
    counted in each task before their counts meet, so a group of any size is a counter. Callers are promised every text's digest, so the full hash
    is computed in the first scan, where the text is at hand, and the refinement saves shuffling it, not computing it.
    """
    text = text_or_empty(text_col)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), *_measures(text), F.sha2(text, 256).alias("digest")))
    left = narrowed(rows, ambiguous(rows), ["len", "prefix"])
    groups = left.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("size")).where("size > 1")
    return rows, stored(groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts form one group. Of equal texts the row with the largest id stays (a
    null id is smaller than any other; of rows that repeat both id and text exactly one stays). An empty table gives
    no rows. Other columns of `docs` are ignored, whatever their names.
    """
    rows, groups = groups_of_equal_texts(docs, id_col, text_col)
    return rows.join(checked_broadcast(groups), "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns, whatever their names: one of each text, null counting as empty; of
    rows that repeat id and text one. An empty table stays empty.

    Texts are hashed in full only where length and prefix leave doubt, and only such documents may be moved with their text: all others pass where
    they lie. If doubtful keys don't fit a broadcast, every text counts as doubtful."""
    text = text_or_empty(text_col)
    length, prefix, digest, doubt = (unused(docs, c) for c in ("text_length", "text_prefix", "text_digest", "text_doubt"))
    keys = ambiguous(docs.select(*_measures(text)))
    size, start = _measures(text)
    measured = docs.withColumns({length: size, prefix: start})
    if fits_broadcast(keys):
        marked = measured.join(F.broadcast(keys.toDF(length, prefix).withColumn(doubt, F.lit(True))), [length, prefix], "left")
    else:
        marked = measured.withColumn(doubt, F.lit(True))
    hashed = marked.where(doubt).withColumn(digest, F.sha2(text, 256))
    # Ids of a text are counted first, so that a text with many rows is spread over its ids.
    ids = hashed.groupBy(F.col(digest).alias("d"), F.col(id_col).alias("i")).agg(F.count("*").alias("n"))
    best = ids.groupBy("d").agg(F.max(F.struct("i", "n")).alias("x"), F.sum("n").alias("size")).where("size > 1")
    same, keep, times = (unused(docs, c) for c in ("same_digest", "keep_id", "keep_times"))
    best = stored(best.select(F.col("d").alias(same), F.col("x.i").alias(keep), F.col("x.n").alias(times)))
    found = hashed.join(checked_broadcast(best), F.col(digest) == F.col(same), "left")
    own = F.col(id_col).eqNullSafe(F.col(keep))
    single = found.where(F.col(same).isNull() | (own & (F.col(times) == 1)))
    repeated = found.where(own & (F.col(times) > 1)).dropDuplicates([digest])  # rows that repeat id and text
    parts = (marked.where(F.col(doubt).isNull()), single, repeated)
    return functools.reduce(DataFrame.union, [x.select(*docs.columns) for x in parts])
