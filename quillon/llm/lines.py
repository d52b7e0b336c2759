"""Fuzzy line de-duplication: MinHash of character shingles, banding, exact verification, union-find."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import setsketch, shingles
from quillon.llm.common import WORD, checked_broadcast, forgotten, ship_package, stored, text_or_empty, unused
from quillon.llm.near import Settings, fixed, linked, shared_keys
from quillon.llm.shingles import U64, mixed

#: Code points of a shingle; bands and rows of a band: a pair of similarity 0.8 shares no band with probability 1e-5, one of
#: 0.9 with 1e-10.
WIDTH, BANDS, ROWS = 7, 22, 4
REGISTERS = BANDS * ROWS


#: Where an empty bin looks for a value: tries in a random order of its own, in the end all bins in turn.
PROBES = np.concatenate([(mixed(np.arange(REGISTERS, dtype=np.uint64)[None, :] * U64(1_000_003) + np.arange(8 * REGISTERS, dtype=np.uint64)[:, None]) % U64(REGISTERS)).astype(np.int64), (np.arange(REGISTERS)[:, None] + np.arange(REGISTERS)) % REGISTERS])


def minhash(owner: np.ndarray, elements: np.ndarray, sets: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (uint16, a row for each set) by one hash per element: the range of hashes is cut into `m` bins and a
    bin keeps its least hash; an empty bin takes the value of the first filled one among bins in a random order, the
    same for all sets. owner: the set of each element; their order and repeats don't matter."""
    bins = (((elements >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
    bins += owner * m
    none = ~U64(0)
    least = np.full(sets * m, none)
    np.minimum.at(least, bins, elements)
    filled = least != none
    out = (mixed(least) & U64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    column = empty % m
    row = empty - column
    some = filled.reshape(sets, m).any(axis=1)[empty // m]
    out[empty[~some]] = 0
    empty, row, column = empty[some], row[some], column[some]
    for probes in PROBES:
        if not len(empty):
            break
        probe = row + probes[column]
        hit = filled[probe]
        out[empty[hit]] = out[probe[hit]]
        empty, row, column = empty[~hit], row[~hit], column[~hit]
    return out.reshape(sets, m)


def minhash_of_sets(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """`minhash` of the sets elements[first[i]:first[i+1]]."""
    return minhash(np.repeat(np.arange(len(first) - 1), np.diff(first)), elements, len(first) - 1)


def equal_share(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def line_settings(width: int, num: int, den: int) -> Settings:
    return Settings(functools.partial(shingles.character_shingles, width=width), num, den, minhash_of_sets, ROWS, BANDS, equal_share, REGISTERS)


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share_num: int = 80, share_den: int = 100) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), component_id, component_line, kept.

    Lines are the \\n-split parts of whole texts. Equal lines are one node; two nodes are linked when the Jaccard
    similarity of their sets of `width`-code-point shingles (A-Z kept as they are; a shorter line is one shingle) is at
    least share_num / share_den. Of each component the line with the smallest (id, line_no) stays, null ids last; of
    lines that repeat both, all or none. Null and empty texts have no such line; an empty table gives no rows; other
    columns are ignored.
    """
    settings = line_settings(width, share_num, share_den)
    ship_package(docs.sparkSession)
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("at", "line")).where(F.col("line").rlike(WORD))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("at"))
    # Hashes stand for the lines on the way back; two of 64 bits each.
    of = lambda c: [F.xxhash64(c).alias("h1"), F.xxhash64(c, F.lit(1)).alias("h2")]
    nodes = split.groupBy(F.col("line").alias("text")).agg(F.min(place).alias("first"), F.count("*").alias("lines"))
    nodes = stored(nodes.select("text", "first", "lines", F.monotonically_increasing_id().alias("cls"), *of("text")))

    def signatures(texts: pa.Array) -> np.ndarray:
        """Registers of lines."""
        return np.concatenate([minhash(*shingles.character_windows(data, offsets, width), len(offsets) - 1) for _, data, offsets in shingles.text_slices(texts)])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = [settings.shingle(data, offsets) for _, data, offsets in shingles.text_slices(batch.column(1))]
                n = np.concatenate([np.diff(first) for _, first in made])
                regs = np.concatenate([settings.sketch(h, first) for h, first in made])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), fixed(regs), batch.column(1)], ["cls", "n", "regs", "text"])

    def pool_of(wanted: DataFrame) -> DataFrame:
        return nodes.select("cls", "text").join(wanted, "cls", "left_semi").mapInArrow(described, "cls long, n long, regs binary, text string")

    shared = shared_keys(nodes.select("cls", "text"), lambda texts: settings.keys(signatures(texts)), nodes.count(), BANDS)
    roots = linked(shared, pool_of, settings)
    # Only lines that occur twice or are linked need to learn their component.
    some = nodes.select("cls", "first", "lines", "h1", "h2").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").where("lines > 1 OR root IS NOT NULL")
    some = stored(some.select("first", "h1", "h2", "root"))
    least = stored(some.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least")))
    known = stored(some.join(checked_broadcast(least), "root", "left").select("h1", "h2", F.coalesce("least", "first").alias("least")))
    forgotten(nodes, some)
    lines = split.select("id", "at", *of("line"))
    least = F.coalesce(F.col("least"), place)
    return lines.join(known, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        F.col("at").cast("long").alias("line_no"),
        least["id"].alias("component_id"),
        least["at"].cast("long").alias("component_line"),
        (least["id"].eqNullSafe(F.col("id")) & (least["at"] == F.col("at"))).alias("kept"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_lines (with a word), n_removed, removed (numbers of the lines that go). Rows that share
    an id are counted together; null and empty texts have no lines; an empty table gives no rows."""
    found = fuzzy_lines(docs, id_col, text_col, **options)
    counts = found.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line_no")))).alias("gone"))
    ids = docs.select(id_col)
    return ids.join(counts, ids[id_col].eqNullSafe(counts["_id"]), "left").select(
        id_col,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("gone", F.array().cast("array<bigint>")).alias("removed"),
    )


def drop_fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the lines that `fuzzy_lines` doesn't keep, with all columns, whatever their names.

    Rows are told apart by id and text: rows that share an id lose their own lines only, and of a component the line of the smallest id stays (null ids
    last), then that of the text with the smallest SHA-256, then the first; rows that repeat both lose the same lines. Lines without a word
    stay; null and empty texts stay as they are; an empty table stays empty."""
    key, gone = unused(docs, "line_key"), unused(docs, "lines_gone")
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.sha2(text_or_empty(text_col), 256).alias("digest"))
    keyed = docs.withColumn(key, own)
    found = fuzzy_lines(keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text")), "key", "text", **options)
    lost = found.where(~F.col("kept")).groupBy("key").agg(F.collect_set("line_no").alias(gone)).withColumnRenamed("key", "_key")
    joined = keyed.join(lost, F.col(key).eqNullSafe(F.col("_key")), "left")
    rest = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long"))), "\n")
    text = F.when(F.col(gone).isNull(), docs[text_col]).otherwise(rest)
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
