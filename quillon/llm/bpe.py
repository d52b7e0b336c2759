"""Byte-level BPE encoding and decoding, with long texts cut into overlapping chunks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import vocab
from quillon.llm.common import ship_package, stored, text_or_empty

#: Code points of a chunk, and of the stretch that two neighbouring chunks both see.
CHUNK, OVERLAP = 65_536, 2_048
#: Characters of text that one Arrow batch may hold when it leaves a worker.
BATCH_CHARS = 1_000_000


@functools.lru_cache(maxsize=4)
def pretokens(pattern: str):
    """The pattern for the `regex` module, whose \\s is spelt out so that both engines see the same white space."""
    import regex

    inner = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(inner)


def ends(pattern: str, text: str, whole: bool) -> set[int]:
    """Places after a pre-token of `text`. Unless `whole`, a match that touches the end of the text may go on in what
    follows and doesn't count."""
    found = {m.end() for m in pretokens(pattern).finditer(text)}
    if not whole:
        found.discard(len(text))
    return found


def meeting(pattern: str, text: str, chunk: int) -> int | None:
    """Where tokenising `text` from its start and from place `chunk` agree first: both have a pre-token ending there,
    after a character that isn't white space (so that the look-ahead for white space can't see past the cut)."""
    mine = ends(pattern, text, False)
    for at in sorted(ends(pattern, text[chunk:], False)):
        if at + chunk in mine and not text[at + chunk - 1].isspace():
            return at + chunk
    return None


def encoded(path: str, pattern: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    enc = vocab.encoding(path, pattern)
    ids = [enc.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for _, t in rows]
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in rows], pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
            pa.array([enc.decode_bytes(x) for x in ids], pa.binary()),
        ],
        ["key", "ids", "raw"],
    )


def slices(batch: pa.RecordBatch, most: int = BATCH_CHARS) -> Iterator[list[tuple[str, str]]]:
    """(key, text) rows of an Arrow batch, in lists of at most `most` characters or one row."""
    held, size = [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        t = text.as_py() or ""
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append((key.as_py(), t))
        size += len(t)
    if held:
        yield held


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str = vocab.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, ids (array of token ids), raw (the bytes that the ids decode to).

    Texts of up to `chunk` code points are encoded where they lie. A longer text is cut into chunks that overlap, and
    the chunks are dealt over the cluster; each is pre-tokenised from its own start and again from the start of the
    next chunk, and cut where both agree. The pieces between the cuts are encoded in parallel and put together by
    chunk number. Where no cut is found in an overlap (a pre-token that long), the rest of that text is one piece, so
    the result is always that of the whole text. Equal long texts are encoded once.

    Null text counts as empty (no ids, no bytes); repeated rows, null ids and an empty table give as many rows as
    they have; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    path = ranks_path or vocab.default_ranks()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                yield encoded(path, pattern, some)

    is_long = F.length("text") > chunk
    # The id travels as text beside the columns that Arrow returns; its type is restored below.
    kind = rows.schema["id"].dataType
    short = rows.where(~is_long).select(F.col("id").cast("string").alias("key"), "text").mapInArrow(short_texts, "key string, ids array<int>, raw binary")
    short = short.select(F.col("key").cast(kind).alias(id_col), "ids", "raw")
    keyed = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    pieces = _pieces(keyed.select("key", "text").dropDuplicates(["key"]), pattern, chunk, overlap)
    done = (
        pieces.select(F.concat_ws(":", "key", F.lpad(F.col("piece").cast("string"), 12, "0")).alias("key"), "text")
        .mapInArrow(short_texts, "key string, ids array<int>, raw binary")
        .select(F.split_part("key", F.lit(":"), F.lit(1)).alias("key"), F.split_part("key", F.lit(":"), F.lit(2)).alias("piece"), "ids", "raw")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "raw"))).alias("parts"))
        .select("key", F.flatten(F.col("parts.ids")).alias("ids"), _joined(F.col("parts.raw")).alias("raw"))
    )
    long = keyed.select("id", "key").join(done, "key").select(F.col("id").alias(id_col), "ids", "raw")
    return short.unionByName(long)


def _joined(parts):
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, text) -> (key, piece, text): the pieces' texts in order make up the whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text = value.as_py()
                for i, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key.as_py()], "n": [i], "text": [text[at : at + chunk + overlap]], "last": [at + chunk >= len(text)]},
                        schema=pa.schema([("key", pa.string()), ("n", pa.int64()), ("text", pa.string()), ("last", pa.bool_())]),
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [None if last.as_py() else meeting(pattern, text.as_py(), chunk) for text, last in zip(batch.column("text"), batch.column("last"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cuts, pa.int64())], [*batch.schema.names, "cut"])

    chunks = stored(long.mapInArrow(cut, "key string, n long, text string, last boolean").repartition("key", "n").mapInArrow(meet, "key string, n long, text string, last boolean, cut long"))
    lost = chunks.where("cut IS NULL AND NOT last").groupBy("key").agg(F.min("n").alias("lost"))
    # Numbers only go through the window; one row per chunk.
    cuts = chunks.select("key", "n", "cut").withColumn("from", F.lag("cut").over(W.partitionBy("key").orderBy("n"))).drop("cut")
    placed = chunks.join(cuts, ["key", "n"]).join(lost, "key", "left")
    begin = F.coalesce(F.col("from") - chunk, F.lit(0))
    sound = F.col("lost").isNull() | (F.col("n") < F.col("lost"))
    whole = placed.where(sound).select("key", F.col("n").alias("piece"), F.expr("CAST(NULL AS LONG)").alias("n"), F.substring("text", (begin + 1).cast("int"), F.when(F.col("last"), F.length("text")).otherwise(F.col("cut") - begin).cast("int")).alias("text"))
    own = F.when(F.col("n") == F.col("lost"), begin).otherwise(0)
    rest = (
        placed.where(~sound)
        .select("key", "n", F.col("lost").alias("piece"), F.substring("text", (own + 1).cast("int"), (F.lit(chunk) - own).cast("int")).alias("text"))
        .groupBy("key", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("parts"))
        .select("key", "piece", F.array_join(F.col("parts.text"), "").alias("text"))
    )
    return whole.select("key", "piece", "text").unionByName(rest)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, id_col, text_col, **options).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
