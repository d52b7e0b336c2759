"""Importance resampling towards a target distribution: hashed n-gram counts of both sides, weights from an array of
gains, and a distributed quickselect of the perturbed scores."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ship_package, stored, text_or_empty
from quillon.llm.sharding import numbered

#: Buckets of the feature hash, the longest run of words, and the fewest words of a document that can be drawn.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 3, 20
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 22
#: Random pivot keys of a round of quickselect.
PIVOTS = 24
#: Of every byte: its lower case if it belongs to a word (digits, letters and all bytes of non-ASCII characters), else a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(raw: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of folded bytes, `most` bytes at a time; no word is cut."""
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + most)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def buckets(text: str, most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end in them) of each piece of a text.

    The CRC of a run continues that of the run one word shorter, so each feature costs the bytes of one word."""
    tail: list[bytes] = []
    for words in pieces(text.encode("utf-8", "surrogatepass").translate(FOLDED), most):
        if not words:
            continue
        run = tail + words
        spaced = [b" " + w for w in run]
        crcs = list(map(crc32, run))
        found = [np.fromiter(crcs, np.int64, len(crcs))[len(tail) :]]
        for n in range(1, LONGEST):
            crcs = list(map(crc32, spaced[n:], crcs))
            found.append(np.fromiter(crcs, np.int64, len(crcs))[max(0, len(tail) - n) :])
        tail = run[1 - LONGEST :]
        yield len(words), np.concatenate(found) % BUCKETS


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket. A task adds up what it reads in one array."""
    ship_package(texts.sparkSession)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in parts:
            for t in batch.column(0):
                for _, found in buckets(t.as_py() or ""):
                    total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """By bucket, 1000 times the log of its smoothed share in the target over that in the raw counts, rounded down."""
    spark = raw.sparkSession
    every = spark.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    gain = F.floor(F.lit(1000.0) * F.ln(d("t", 1) * d("all_s", BUCKETS) / (d("s", 1) * d("all_t", BUCKETS))))
    table = both.crossJoin(F.broadcast(sums)).select("bucket", gain.alias("gain")).collect()  # BUCKETS rows
    return [r.gain for r in sorted(table, key=lambda r: r.bucket)]


def noise(id_col: Column, seed: int) -> Column:
    """A Gumbel deviate, times 1000 and rounded down, from the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, table: list[int], seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(table, np.int64)
        for batch in parts:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, t in enumerate(batch.column(1)):
                for words, found in buckets(t.as_py() or ""):
                    rows[i] += words, len(found), int(gain[found].sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(rows.T))], ["id", "n_words", "n_features", "weight"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(weigh, f"id {kind.simpleString()}, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def better(score: Column, id_: Column, than_score: Column, than_id: Column) -> Column:
    """Does a composite key come before another: by higher score, then smaller id, null ids last?"""
    earlier = F.coalesce(id_ < than_id, id_.isNotNull() & than_id.isNull())
    return (score > than_score) | ((score == than_score) & earlier)


def kth_key(rows: DataFrame, k: int, seed: int = 1) -> tuple[int, object] | None:
    """The k-th (from 1) best composite key (score, id) of `rows`; None if there are fewer than k rows.

    Each round draws PIVOTS of the keys still in question at random (the smallest hashes of key and round), counts exactly how
    many rows lie between them and how many equal one, and goes on between the two pivots about the k-th key, or ends
    at a pivot that is it. Rows are neither sorted nor sent anywhere; a round shrinks what is left by about PIVOTS times.
    """
    score, id_ = F.col("score"), F.col("id")
    kind = rows.schema["id"].dataType
    lit = lambda p: (F.lit(p["score"]), F.lit(p["id"]).cast(kind))
    left, round_, gone = rows.select("score", "id"), 0, 0
    while True:
        round_ += 1
        drawn = left.distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(round_), score, id_), score, id_).limit(PIVOTS)
        pivots = [r.asDict() for r in drawn.collect()]
        if not pivots:
            return None
        pivots.sort(key=lambda p: (-p["score"], p["id"] is None, p["id"]))
        after = sum((better(*lit(p), score, id_).cast("int") for p in pivots), F.lit(0))  # pivots before the row
        equal = F.lit(False)
        for p in pivots:
            s, i = lit(p)
            equal = equal | ((score == s) & id_.eqNullSafe(i))
        counts = {(r.after, r.equal): r.n for r in left.groupBy(after.alias("after"), equal.alias("equal")).agg(F.count("*").alias("n")).collect()}  # two rows a pivot
        for j in range(len(pivots) + 1):
            within = counts.get((j, False), 0)
            if gone + within >= k:
                if j:
                    left = left.where(better(*lit(pivots[j - 1]), score, id_))
                if j < len(pivots):
                    left = left.where(better(score, id_, *lit(pivots[j])))
                break
            gone += within
            if j == len(pivots):
                return None
            same = counts.get((j, True), 0)
            if gone + same >= k:
                return pivots[j]["score"], pivots[j]["id"]
            gone += same


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per document: id, n_features, weight, score, and rank from 1 of the `percent` of documents drawn (of those
    with at least `least_words` words, rounded down), null for the others. Drawing the highest weight + Gumbel noise samples
    without replacement in proportion to the importance weights.

    Null and empty texts have no features, weight 0, and can't be drawn. A null id is hashed as an empty one and comes after
    all others at equal scores. Rows that repeat an id share noise; whole repeats are interchangeable, each is ranked, and at the last
    place as many are drawn as fit. An empty target leaves the weights to the raw counts; no documents, no rows. Texts of any length
    are read in pieces. Columns of other names are not looked at.
    """
    table = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    rows = stored(weighed(docs, table, seed, id_col, text_col))
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * percent // 100
    key = kth_key(rows.where(able), k) if k else None
    out = lambda df, rank: df.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    if key is None:
        return out(rows, F.lit(None))
    s, i = F.lit(key[0]), F.lit(key[1]).cast(rows.schema["id"].dataType)
    wins = able & ~better(s, i, F.col("score"), F.col("id"))
    ranked, _ = numbered(rows.where(wins).withColumn("fall", -F.col("score")), ["fall", "id"])
    return out(ranked, F.when(F.col("n") < k, F.col("n") + 1)).unionByName(out(rows.where(~wins), F.lit(None)))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `resample` draws, with all their columns, whatever their names. Ids must tell rows apart:
    rows that share id and text are drawn together, once each, if one of them is."""
    ranks = resample(docs.withColumn(text_col, text_or_empty(text_col)), target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    chosen = ranks.select(F.col(id_col).alias("i")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["i"]), "left_semi")
