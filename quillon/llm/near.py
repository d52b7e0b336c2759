"""Near-duplicates by Jaccard similarity of shingle sets: sketches, banding, joint likelihood, exact verification, and
union-find. Nothing here depends on what the shingles are made of.

Classes (rows with equal sets) that share a band are candidates. First each class is compared with the smallest class of
the bucket that it shares most bands with; after union-find, buckets that still hold several components are compared
across components, blocks of a bucket at a time, so that no link is left out because of a bucket's size. Wherever two
classes meet, registers and texts are at hand: likelihood estimates rule out most pairs, and the full sets decide the
others there and then, likeliest first, unless links found before have joined the two already. So only links leave a
task, fewer than it has classes."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import setsketch, shingles
from quillon.llm.common import checked_broadcast, forgotten, ship_package, stored, text_or_empty, unused
from quillon.llm.components import connected, followed

#: A bucket of more classes or bytes than this is compared in blocks of about as much.
BLOCK, BLOCK_BYTES = 1024, 6_000_000
#: Bytes of classes in a shard of blocks, and pairs that are compared at a time.
SHARD_BYTES, STEP = 24_000_000, 20_000
#: Band hashes that are brought together in one task, and that a task puts together before it sends them.
SHARD_KEYS, FLUSH_KEYS = 1_000_000, 1_000_000
#: Standard errors below the threshold at which a likelihood estimate still goes to verification.
ERRORS = 4.5


@dataclass(frozen=True)
class Settings:
    """Link when share_den * intersection >= share_num * union, over the sets that `shingle` makes of texts."""

    shingle: Callable  # (bytes, offsets) -> (hashes, first hash of each text)
    share_num: int = 85
    share_den: int = 100
    sketch: Callable = setsketch.sketches  # (hashes, first) -> registers
    rows: int = setsketch.ROWS
    bands: int = setsketch.BANDS
    estimate: Callable = setsketch.estimates
    registers: int = setsketch.REGISTERS

    @property
    def least(self) -> float:
        """The estimate below which a link is ruled out: ERRORS standard errors under the threshold."""
        t = self.share_num / self.share_den
        return t - ERRORS * math.sqrt(t * (1 - t) / self.registers)

    def keys(self, regs: np.ndarray) -> np.ndarray:
        """Band hashes of rows of registers."""
        return setsketch.bands(regs, self.rows, self.bands)


@functools.cache
def word_settings(width: int, num: int, den: int) -> Settings:
    return Settings(functools.partial(shingles.word_shingles, width=width), num, den)


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    width = values.dtype.itemsize * values.shape[1]
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def registers_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as a 2-d array of uint16."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1] if n else np.zeros(1, kind)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(n, -1) if n else np.zeros((0, 1), np.uint16)


def sketched(items: DataFrame, settings: Settings) -> DataFrame:
    """(id, text) -> id, row, tkey, n, k1, k2, regs: a row's set by size and two sums of hashes, and its registers."""
    ship_package(items.sparkSession)
    rows = items.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("tkey"), "text")
    out = T.StructType([*rows.schema.fields[:3], *(T.StructField(c, T.LongType()) for c in ("n", "k1", "k2")), T.StructField("regs", T.BinaryType())])
    salt = np.uint64(0x5851F42D4C957F2D)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in shingles.text_slices(batch.column(3)):
                h, first = settings.shingle(data, offsets)
                count = len(first) - 1
                sums = []
                for x in (h, shingles.mixed(h ^ salt)):
                    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                    sums.append(pa.array((c[first[1:]] - c[first[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, count) for c in batch.columns[:3]), pa.array(np.diff(first)), *sums, fixed(settings.sketch(h, first))], ["id", "row", "tkey", "n", "k1", "k2", "regs"])

    return rows.mapInArrow(run, out)


def shared_keys(classes: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], count: int, per_class: int) -> DataFrame:
    """(key, cls) of the band hashes that two classes or more have. classes: cls and a column that `keys_of` makes
    band hashes of, a row for each class; count: how many classes there are.

    A task puts the keys of many classes together by shard, one binary value each, and a shard finds the repeated ones
    by sorting numbers. Of a key that a task has several times it sends one class to the key's shard and the others,
    known to share it, past it, so a shard gets a key once from a task at most, however many classes have it.
    """
    shards = max(1, -(-count * per_class // SHARD_KEYS))
    names = ["shard", "known", "keys", "cls"]
    flag = np.int64(1) << np.int64(62)

    def dealt(keys: np.ndarray, cls: np.ndarray, turn: int) -> Iterator[pa.RecordBatch]:
        cls = np.repeat(cls, keys.shape[1])
        keys = keys.reshape(-1)
        shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        full = (shard << 32) | (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(full)
        full, cls = full[order], cls[order]
        first = np.concatenate([[True], full[1:] != full[:-1]])
        several = np.append(first[1:], True) < first  # first of more than one
        low = [full[first], np.where(several[first], cls[first] | flag, cls[first])]
        cut = np.searchsorted(low[0] >> 32, np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [[(x[cut[s] : cut[s + 1]].astype(np.uint32) if x is low[0] else x[cut[s] : cut[s + 1]]).tobytes() for s in some] for x in low]
        rest = ~first
        if rest.any():
            some = np.append(some, turn % shards)
            for b, x in zip(blobs, (full[rest], cls[rest]), strict=True):
                b.append(x.tobytes())
        known = np.zeros(len(some), bool)
        known[len(some) - int(rest.any()) :] = True
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(known), *(pa.array(b, pa.binary()) for b in blobs)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if len(batch):
                held.append((keys_of(batch.column(1)), batch.column(0).to_numpy()))
                n += held[-1][0].size
            if n >= FLUSH_KEYS:
                yield from dealt(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]), int(held[0][1][0]))
                held, n = [], 0
        if held:
            yield from dealt(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]), int(held[0][1][0]))

    def find(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, cls = [], []
        for known, k, c in zip(table.column("known"), table.column("keys"), table.column("cls"), strict=True):
            if known.as_py():
                keys.append(np.frombuffer(k.as_py(), np.int64))
                cls.append(np.frombuffer(c.as_py(), np.int64))
        at = pa.compute.filter(table, pa.compute.invert(table.column("known"))) if keys else table
        low = np.frombuffer(b"".join(x.as_py() for x in at.column("keys")), np.uint32)
        own = np.frombuffer(b"".join(x.as_py() for x in at.column("cls")), np.int64)
        order = np.argsort(low, kind="stable")
        low, own = low[order], own[order]
        same = low[1:] == low[:-1]
        on = np.append(same, False) | np.append(False, same) | (own >= flag) if len(low) else np.zeros(0, bool)
        keys.append((np.int64(shard) << 32) | low[on].astype(np.int64))
        cls.append(own[on] & ~flag)
        return pa.table({"key": np.concatenate(keys), "cls": np.concatenate(cls)})

    blobs = classes.mapInArrow(run, "shard int, known boolean, keys binary, cls binary")
    return blobs.groupBy("shard").applyInArrow(find, "key long, cls long")


def sets_of(texts: pa.Array, settings: Settings) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in shingles.text_slices(texts):
        h, first = settings.shingle(data, offsets)
        out += np.split(h, first[1:-1])
    return out


def meets(x: np.ndarray, y: np.ndarray, settings: Settings) -> bool:
    """Whether two full sets are linked."""
    num, den = settings.share_num, settings.share_den
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = np.count_nonzero(both[1:] == both[:-1])
    return den * common >= num * (len(both) - common)


def _star_links(stars: DataFrame, pool: DataFrame, settings: Settings) -> DataFrame:
    """Of pairs (a, b), a row for each b, those linked: likelihood first, then full sets."""

    @F.arrow_udf("boolean")
    def are_linked(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ra, rb, na, nb, ta, tb in parts:
            out = np.zeros(len(ta), bool)
            if len(ta):
                na, nb = na.to_numpy(), nb.to_numpy()
                fit = np.flatnonzero(settings.share_den * np.minimum(na, nb) >= settings.share_num * np.maximum(na, nb))
                likely = fit[settings.estimate(registers_of(ra)[fit], registers_of(rb)[fit], na[fit], nb[fit]) >= settings.least] if len(fit) else fit
                hubs = pa.compute.dictionary_encode(ta.take(pa.array(likely)))  # a hub's pairs lie together
                of_hub, codes = sets_of(hubs.dictionary, settings), hubs.indices.to_numpy()
                for at in range(0, len(likely), 500):
                    for i, c, y in zip(likely[at : at + 500], codes[at : at + 500], sets_of(tb.take(pa.array(likely[at : at + 500])), settings), strict=True):
                        out[i] = meets(of_hub[c], y, settings)
            yield pa.array(out)

    a, b = (pool.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    # Joins with texts are merged at every size, so that a small run has the plan of a large one.
    return stars.join(b.hint("merge"), "b").join(a.hint("merge"), "a").where(are_linked("ra", "rb", "na", "nb", "ta", "tb")).select("a", "b")


def _open_members(shared: DataFrame, roots: DataFrame, pool: DataFrame, settings: Settings) -> DataFrame:
    """Rows of buckets with several components: key, cls, root, minor, blocks, few, rows, w.

    minor: the row is outside the bucket's largest component; blocks and few: into how many blocks the bucket and its
    minor rows are dealt."""
    weight = F.col("n") * 8 + 2 * settings.registers + 64
    labelled = stored(shared.join(pool.select("cls", "n"), "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"), weight.alias("w")))
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("w").alias("w"))
    split = parts.groupBy("key").agg(F.max(F.struct("rows", "root", "w")).alias("most"), F.sum("rows").alias("rows"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda rows, w: F.ceil(F.greatest(rows / BLOCK, w / BLOCK_BYTES)).cast("long")
    split = stored(
        split.select("key", F.col("most.root").alias("major"), blocks(F.col("rows"), F.col("w")).alias("blocks"), blocks(F.col("rows") - F.col("most.rows"), F.col("w") - F.col("most.w")).alias("few"), "rows")
    )
    open_ = stored(labelled.join(split, "key").select("key", "cls", "root", (F.col("root") != F.col("major")).alias("minor"), "blocks", "few", "rows", "w"))
    forgotten(labelled, split)
    return open_


def _placed(open_: DataFrame, every: bool) -> tuple[DataFrame, int]:
    """Where rows meet, (place, side, key, cls, root, minor), and a number of shards for the places.

    In large buckets rows outside the largest component and all rows are dealt at random to blocks, and two blocks meet
    in one place, so nothing grows with a bucket. Unless `every`, a class goes only to its largest bucket, where rows
    of a block meet each other: most components grow together there, at the cost of one row for each class."""
    if every:
        left = open_.where("minor").select("*", F.pmod(F.xxhash64("cls"), F.col("few")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(1).alias("side"))
        right = open_.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("s"), F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).alias("j"), F.lit(0).alias("side"))
        size = open_.agg(F.sum(F.col("w") * (F.col("few") + F.when(F.col("minor"), F.col("blocks")).otherwise(0)))).first()[0] or 0
        rows = left.unionByName(right)
    else:
        one = open_.groupBy("cls").agg(F.max(F.struct("rows", "key", "root", "minor", "blocks", "w")).alias("x")).select("cls", "x.*")
        rows = one.select("*", F.lit(0).alias("s"), F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("j"), F.lit(2).alias("side"))
        size = open_.dropDuplicates(["cls"]).agg(F.sum("w")).first()[0] or 0
    return rows.select(F.xxhash64("key", "s", "j").alias("place"), "side", "key", "cls", "root", "minor"), max(1, -(-size // SHARD_BYTES))


def _links_across(rows: DataFrame, shards: int, pool: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of components (a, b) that links join, fewer than a shard has components: of rows that meet in a place and
    belong to different components, likelihood estimates rule pairs out, and full sets decide the others.

    rows: place, side (1 meets 0; 2 meets 2), key, cls, root, minor."""
    estimate, least, num, den = settings.estimate, settings.least, settings.share_num, settings.share_den

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, cls, n, root, minor, place = (table.column(c).to_numpy() for c in ("side", "cls", "n", "root", "minor", "place"))
        order = np.lexsort((side, place))  # in each place the right side first
        side, cls, n, root, minor, place = (x[order] for x in (side, cls, n, root, minor, place))
        regs = registers_of(table.column("regs"))[order]
        texts = table.column("text").combine_chunks()
        # A key has its band hash's lower 32 bits.
        band = ((settings.keys(regs).astype(np.uint32) == table.column("key").to_numpy()[order].astype(np.uint32)[:, None])).argmax(axis=1)
        begin = np.searchsorted(place, place, "left")
        end = np.searchsorted(place, place, "right")
        # A row of side 1 meets the rows of side 0, which come before it; a row of side 2 those after it.
        ones = np.concatenate([[0], np.cumsum(side == 1)])
        from_ = np.where(side == 2, np.arange(len(side)) + 1, begin)
        until = np.where(side == 2, end, end - (ones[end] - ones[begin]))
        width = np.where(side > 0, until - from_, 0)
        lefts = np.flatnonzero(width)
        width = width[lefts]
        up: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        links: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        joined = root
        # The last cut is the end: a search for a sum that is met exactly gives the row that meets it.
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(width), np.arange(0, int(width.sum()), STEP), "left"), len(lefts)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = np.repeat(lefts[a:b], width[a:b])
            j = np.arange(len(i)) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b]) + from_[i]
            fit = (joined[i] != joined[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
            fit &= ~((side[i] == 1) & minor[j] & (cls[i] > cls[j]))  # two minor rows meet twice
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            likely = estimate(regs[i], regs[j], n[i], n[j])
            good = likely >= least
            i, j, likely = i[good], j[good], likely[good]
            if len(i) and side[i[0]] == 1:
                # A pair that meets in several buckets is verified in that of its first common band only.
                here, there = settings.keys(regs[i]), settings.keys(regs[j])
                good = (here == there).argmax(axis=1) == band[i]
                i, j, likely = i[good], j[good], likely[good]
            rank = np.argsort(-likely, kind="stable")
            i, j = i[rank], j[rank]
            new = [x for x in np.unique(np.concatenate([i, j])).tolist() if x not in sets]
            for x, s in zip(new, sets_of(texts.take(pa.array(order[new])), settings) if new else [], strict=True):
                sets[x] = s
            before = len(links)
            for p, q, x, y in zip(i.tolist(), j.tolist(), root[i].tolist(), root[j].tolist(), strict=True):
                rx, ry = find(x), find(y)
                if rx != ry and meets(sets[p], sets[q], settings):
                    up[rx] = ry
                    links.append((x, y))
            if len(links) > before:
                names, back = np.unique(root, return_inverse=True)
                joined = np.array([find(x) for x in names.tolist()])[back]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    whole = rows.join(pool.select("cls", "n", "regs", "text").hint("merge"), "cls")
    return whole.withColumn("shard", F.pmod("place", F.lit(shards))).groupBy("shard").applyInArrow(run, "a long, b long")


def linked(shared: DataFrame, pool_of: Callable[[DataFrame], DataFrame], settings: Settings) -> DataFrame:
    """(node, root) of the classes with links. shared: key, cls, from `shared_keys`; pool_of: from classes (cls) to
    one row of each, cls, n, regs, text."""
    found = stored(shared)
    buckets = found.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("rows"))
    shared = stored(found.join(buckets, "key"))
    forgotten(found)
    # A class is compared first with the hub that it shares most bands with.
    votes = shared.where("cls <> hub").select("cls", "hub").repartition("cls").groupBy("cls", "hub").agg(F.count("*").alias("bands"))
    stars = stored(votes.groupBy("cls").agg(F.max(F.struct("bands", "hub")).alias("x")).select(F.col("x.hub").alias("a"), F.col("cls").alias("b")))
    pool = stored(pool_of(shared.select("cls").distinct()))
    roots = connected(_star_links(stars, pool, settings))
    # A bucket of two that have been compared is done with.
    done = shared.where("rows = 2 AND cls <> hub").join(stars.select(F.col("b").alias("cls"), F.col("a").alias("hub")), ["cls", "hub"]).select("key")
    shared = stored(shared.select("key", "cls").join(done, "key", "left_anti"))
    for every in (False, True):
        open_ = _open_members(shared, roots, pool, settings)
        if not open_.limit(1).count():
            break
        rows, shards = _placed(open_, every)
        more = stored(_links_across(rows, shards, pool, settings))
        forgotten(open_)
        if more.limit(1).count():
            roots = followed(roots, connected(more))
    return roots


def near_duplicates(items: DataFrame, settings: Settings) -> DataFrame:
    """(id, text) -> id, row, tkey, n, first_id, first_row: the smallest (id, row) of each row's component.

    Rows with equal sets form a class, linked by being equal. A null id comes after all others.
    """
    items = items.select("id", text_or_empty("text").alias("text"))
    rows = stored(sketched(items, settings))
    repeats = rows.groupBy("id", "tkey").count().where("count > 1").limit(1).count() > 0
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    keys = stored(rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("rows"))).select("n", "k1", "k2", "first", F.col("first.row").alias("cls"), "rows")
    # The rows that stand for no class are few, so that the registers of the others need not travel.
    others = rows.select("row", "n", "k1", "k2").join(keys.where("rows > 1").select("n", "k1", "k2", "cls"), ["n", "k1", "k2"]).where("row <> cls").select("row")
    classes = stored(rows.where("n > 0").join(checked_broadcast(stored(others)), "row", "left_anti").withColumnRenamed("row", "cls"))

    def pool_of(wanted: DataFrame) -> DataFrame:
        known = stored(classes.join(wanted, "cls", "left_semi").select("cls", "n", "regs", F.col("id").alias("_id"), F.col("tkey").alias("_tkey")))
        texts = items.withColumn("tkey", F.xxhash64("text"))
        texts = texts.join(checked_broadcast(known.select("cls", "_id", "_tkey")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))).select("cls", "text")
        return known.select("cls", "n", "regs").join((texts.dropDuplicates(["cls"]) if repeats else texts).hint("merge"), "cls")

    shared = shared_keys(classes.select("cls", "regs"), lambda regs: settings.keys(registers_of(regs)), classes.count(), settings.bands)
    roots = linked(shared, pool_of, settings)
    forgotten(classes)
    placed = keys.join(roots.select(F.col("node").alias("cls"), "root"), "cls")
    firsts = placed.groupBy("root").agg(F.min("first").alias("least"))
    moved = stored(placed.select("n", "k1", "k2", "root").join(checked_broadcast(stored(firsts)), "root").select("n", "k1", "k2", "least"))
    alone = keys.join(moved, ["n", "k1", "k2"], "left_anti").select("n", "k1", "k2", F.col("first").alias("least"))
    known = stored(moved.unionByName(alone))
    return rows.drop("regs").join(known, ["n", "k1", "k2"], "left").select(
        "id",
        "row",
        "tkey",
        "n",
        F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("first_id"),
        F.when(F.col("least").isNull(), F.col("row")).otherwise(F.col("least.row")).alias("first_row"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share_num: int = 85, share_den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept; and tkey, a hash of the text.

    A document's set has its distinct `width`-word shingles, A-Z in lower case; with fewer words, the whole sequence as
    one; a null, empty or white text has none and is linked with nothing. component_id is the smallest id that links
    reach, null ids last; the row that has it is kept (of rows repeating an id and a text, one). An empty table gives
    no rows; other columns are ignored.
    """
    found = near_duplicates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), word_settings(width, share_num, share_den))
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first_id").alias("component_id"),
        (F.col("first_row") == F.col("row")).alias("kept"),
        "tkey",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `near_dedup` keeps, with all their columns, whatever their names (rows repeating id and text
    once). Documents without words are linked with nothing, so all stay; an empty table stays empty."""
    kept = near_dedup(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("i"), F.col("tkey").alias("k")).distinct()
    tkey = unused(docs, "text_key")
    named = docs.withColumns({tkey: F.xxhash64(text_or_empty(text_col))})
    out = named.join(kept, named[id_col].eqNullSafe(kept["i"]) & (named[tkey] == kept["k"]), "left_semi")
    again = named.groupBy(id_col, tkey).count().where("count > 1").limit(1).count()
    return (out.dropDuplicates([id_col, tkey]) if again else out).drop(tkey)
