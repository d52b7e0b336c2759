"""Removal of long byte strings that other documents hold too, by suffix arrays over shards of candidate strings.

Every window of LENGTH bytes has an anchor, its GRAM-byte string of least hash; equal windows have equal anchors. The
consecutive windows with one anchor make a segment of at most 2 * LENGTH bytes, so documents share a window only if they
share an anchor. Segments are dealt by anchor. Equal segments are combined first, in each task and then by anchor: in all
but the first document that holds one, every byte of it goes. What is left are different segments with one anchor, at
the edges of passages or by chance; those that also agree far enough to both sides of it for a common window have their
texts dealt to shards by anchor, and each shard's suffix array, built by induced sorting, gives with its permuted common
prefixes the windows that an earlier document holds too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import shingles
from quillon.llm.common import forgotten, ship_package, stored, text_or_empty
from quillon.llm.mixing import row_hash
from quillon.llm.shingles import ODD, U64, mixed
from quillon.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 50, 24
#: Segments that are dealt together, segments in a shard of anchors, and bytes of text in a shard of strings.
FLUSH, SHARD_SEGMENTS, SHARD_BYTES = 300_000, 400_000, 600_000
#: Documents, about, in the sample that finds frequent anchors, and in how many of them such an anchor occurs.
HEAVY_SAMPLE, HEAVY = 4_000, 40
#: Parts of the places that an anchor can have in a window, and bits of the hash of what the windows of a part have in common.
PARTS, PART_BITS = 3, 10
#: In place of a null id: such a document comes after all others.
LAST = 2**63 - 1

SALT = U64(0x2545F4914F6CDD1D)
#: A random number for each byte.
RAW = np.random.default_rng(50_331_653).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def offset_ranges(width: int) -> list[tuple[int, int]]:
    """0 .. width - 1 in ranges that are short at both ends and double towards the middle."""
    low, size, out = 0, 1, []
    while low + size <= width // 2:
        out.append((low, low + size - 1))
        low, size = low + size, 2 * size
    mirrored = [(width - 1 - b, width - 1 - a) for a, b in reversed(out)]
    return out + ([(low, width - 1 - low)] if 2 * low < width else []) + mirrored


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, frequent: np.ndarray | None = None, cores: bool = False) -> tuple[np.ndarray, ...]:
    """(document, first byte in it, bytes, anchor hash, hash of its bytes) of every segment of the documents.

    With `cores`, also PARTS short hashes in one number: for each part of the places that the anchor can have in a window,
    of the bytes that all its windows have in common, or 0 if the segment has no such window. Segments with a window in
    common have the same anchor and the same hash for its part.

    The segments of a frequent anchor (sorted hashes) are split by where in the window the anchor stands, and get a
    longer key: all that the windows of a part have in common, on both sides of the anchor. So strings that share an
    anchor by the million, but differ around it, are dealt by what is around it."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), *[none.astype(np.uint32)] * cores
    up, down = shingles.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(RAW[data] * up[:n], out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width = length - gram + 1
    # Least hash of each run of `width`, by doubling. Only hashes are compared, so equal strings behave alike.
    least, size = h, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(h) - width + 1], least[width - size : width - size + len(h) - width + 1])
    # The leftmost least place changes after a window that begins with it, or when a smaller hash comes in.
    begins = np.ones(len(least), bool)
    begins[1:] = (h[: len(least) - 1] == least[:-1]) | (least[1:] < least[:-1])
    inside = np.ones(len(least), bool)
    for at in offsets[1:-1]:
        inside[max(at - length + 1, 0) : at] = False
        begins[at : at + 1] = True
    begin = np.flatnonzero(begins & inside)
    # A segment ends at the next one, or where its document's windows end.
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(begin, offsets)))
    last = np.minimum(np.append(begin[1:], n), offsets[doc + 1] - length + 1) - 1  # first byte of the last window
    key = least[begin]
    # The anchor's place, the first one with its hash: where the last window begins, or else after it; where the first
    # window ends, if that brought it in.
    at = np.where(h[last] == key, last, begin + width - 1)
    open_ = np.flatnonzero((at != last) & ((begin == 0) | (key >= least[np.maximum(begin - 1, 0)])))
    at[open_] = last[open_] + 1
    while len(open_):
        open_ = open_[h[at[open_]] != key[open_]]
        at[open_] += 1
    if frequent is not None and len(frequent) and len(key):
        often = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
        parts = [(doc[~often], begin[~often], last[~often], key[~often], at[~often])]
        for x, y in offset_ranges(width):
            a, b = np.maximum(begin[often], at[often] - y), np.minimum(last[often], at[often] - x)
            some = a <= b
            a, b, c = a[some], b[some], at[often][some]
            common = (sums[c + length - y] - sums[c - x]) * down[c - x]
            parts.append((doc[often][some], a, b, mixed(common ^ mixed(np.array([SALT]) + U64(x))), c))
        doc, begin, last, key, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(begin, kind="stable")
        doc, begin, last, key, at = (x[order] for x in (doc, begin, last, key, at))
    end = last + length
    # A hash of the bytes, eight at a time from the front, which every segment has, and then those up to the end.
    eight = np.ndarray(n + 1, np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    word = min(length, 8)
    mask = ~U64(0) >> U64(64 - 8 * word)
    whole = mixed((end - begin).astype(np.uint64) + SALT)
    rest = -(-int((end - begin).max(initial=0) - length // word * word) // word)
    for k in [*range(length // word), *range(-rest, 0)]:
        whole ^= eight[np.maximum(end + k * word, begin) if k < 0 else begin + k * word] & mask
        whole *= ODD
        whole ^= whole >> U64(32)
    whole = mixed(whole)
    if not cores:
        return doc, begin - offsets[doc], end - begin, key, whole
    core = np.zeros(len(key), np.uint32)
    for k in range(PARTS):
        x, y = k * width // PARTS, (k + 1) * width // PARTS - 1
        some = np.flatnonzero((at - begin >= x) & (at - last <= y)) if x <= y else none
        c = at[some]
        common = (sums[c + length - y] - sums[c - x]) * down[c - x]
        short = np.maximum(((common ^ (common >> U64(32))) * ODD) >> U64(64 - PART_BITS), U64(1))
        core[some] |= (short << U64(k * PART_BITS)).astype(np.uint32)
    return doc, begin - offsets[doc], end - begin, key, whole, core


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(ord, tkey, text: the id, null last, a hash of the text, and the text; the columns that tell rows apart)."""
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must hold whole numbers, whose order says which document comes first; it is {kind}")
    text = text_or_empty(text_col)
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    repeats = docs.select(ord_.alias("ord")).groupBy("ord").count().where("count > 1").limit(1).count() > 0
    tkey = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    return docs.select(ord_.alias("ord"), tkey.alias("tkey"), text.alias("text")), ["ord", "tkey"] if repeats else ["ord"]


def _frequent(rows: DataFrame, length: int, gram: int) -> np.ndarray:
    """Hashes of the anchors of at least HEAVY documents of a sample: at most the sample's anchors / HEAVY."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in shingles.text_slices(batch.column(1)):
                doc, _, _, key, _ = segments(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(batch.column(0).to_numpy()[first + doc])], ["key", "ord"])

    share = min(1.0, HEAVY_SAMPLE / max(rows.count(), 1))
    sample = rows.where(row_hash("ord") < F.lit(int(share * (1 << 60)))).select("ord", "text").mapInArrow(anchors, "key long, ord long")
    heavy = sample.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY)
    return np.sort(np.array([r["key"] for r in heavy.collect()], np.int64).view(np.uint64))


FOUND = "covered boolean, ord long, tkey long, lo array<int>, size array<int>, key array<bigint>"


def by_document(covered: bool, ord_: np.ndarray, tkey: np.ndarray, lo: np.ndarray, size: np.ndarray, key: np.ndarray | None = None) -> pa.Table:
    """Rows of FOUND, one for each document. Of covered places, those that overlap or touch are made one."""
    order = np.lexsort((lo, tkey, ord_))
    ord_, tkey, lo, size = ord_[order], tkey[order], lo[order].astype(np.int64), size[order].astype(np.int64)
    key = np.zeros(len(lo), np.int64) if key is None else key[order]
    new = np.append(True, (ord_[1:] != ord_[:-1]) | (tkey[1:] != tkey[:-1]))[: len(lo)]
    if covered and len(lo):
        group = np.cumsum(new) - 1
        far = int((lo + size).max()) + 1
        reach = np.maximum.accumulate(group * far + lo + size)  # documents one after the other
        fresh = new | np.append(True, (group * far + lo)[1:] > reach[:-1])
        end = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(lo) - 1)] - group[fresh] * far
        ord_, tkey, lo, key, new = ord_[fresh], tkey[fresh], lo[fresh], key[fresh], new[fresh]
        size = end - lo
    cut = np.append(np.flatnonzero(new), len(lo)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (lo.astype(np.int32), size.astype(np.int32), key)]
    first = cut[:-1]
    return pa.table([pa.array(np.full(len(first), covered)), pa.array(ord_[first]), pa.array(tkey[first]), *lists], ["covered", "ord", "tkey", "lo", "size", "key"])


BLOB = {"ord": np.int64, "tkey": np.int64, "lo": np.int32, "size": np.int32, "key": np.uint32, "whole": np.uint64, "core": np.uint32}


def agreeing(anchor: np.ndarray, first: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Whether a segment, in the document `first`, agrees with one of its anchor in another document in what the windows of
    some part have in common: without that, they have no window in common."""
    out = np.zeros(len(anchor), bool)
    for k in range(PARTS):
        short = (core >> np.uint32(k * PART_BITS)) & np.uint32((1 << PART_BITS) - 1)
        some = np.flatnonzero(short)
        if len(some):
            both = (anchor[some].astype(np.int64) << PART_BITS) | short[some]
            order = np.argsort(both)
            some, both = some[order], both[order]
            new = np.append(True, both[1:] != both[:-1])
            least, most = (f.reduceat(first[some], np.flatnonzero(new)) for f in (np.minimum, np.maximum))
            out[some] |= (least < most)[np.cumsum(new) - 1]
    return out


def _compared(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """FOUND: covered, places whose bytes an earlier document holds as a whole segment; otherwise, the segments to be
    compared in suffix arrays, those of each anchor that has different ones that agree far enough around it, in the first
    document that holds them."""
    frequent = _frequent(rows, length, gram)
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (SHARD_SEGMENTS * (length - gram + 2) // 2)))
    names = ["shard", "covered", *BLOB]

    def dealt(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ord_, tkey, lo, size, key, whole, core = (np.concatenate(x) for x in zip(*held, strict=True))
        both = mixed(key + mixed(whole))
        order = np.argsort(both)
        new = np.append(True, both[order][1:] != both[order][:-1])
        least = np.minimum.reduceat(ord_[order], np.flatnonzero(new))
        later = np.zeros(len(ord_), bool)
        later[order] = ord_[order] > least[np.cumsum(new) - 1]
        shard = ((key >> U64(32)) % U64(shards)).astype(np.int64)
        own = np.flatnonzero(~later)
        own = own[np.argsort(shard[own].astype(np.uint16) if shards < 1 << 16 else shard[own], kind="stable")]
        cut = np.searchsorted(shard[own], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cut))
        columns = dict(zip(BLOB, (ord_, tkey, lo, size, key & U64(0xFFFFFFFF), whole, core), strict=True))
        blobs = {c: [columns[c][own[cut[s] : cut[s + 1]]].astype(k).tobytes() for s in some] for c, k in BLOB.items()}
        if later.any():
            for c, k in BLOB.items():
                blobs[c].append(columns[c][later].astype(k).tobytes() if c in ("ord", "tkey", "lo", "size") else b"")
            some = np.append(some, int(ord_[0]) % shards)
        covered = np.arange(len(some)) >= len(some) - int(later.any())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(covered), *(pa.array(b, pa.binary()) for b in blobs.values())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            ords, tkeys = (batch.column(i).to_numpy() for i in (0, 1))
            for first, data, offsets in shingles.text_slices(batch.column(2)):
                doc, lo, size, key, whole, core = segments(data, offsets, length, gram, frequent, cores=True)
                if len(doc):
                    held.append((ords[first + doc], tkeys[first + doc], lo, size, key, whole, core))
                    n += len(doc)
                if n >= FLUSH:
                    yield from dealt(held)
                    held, n = [], 0
        if held:
            yield from dealt(held)

    def find(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        done = table.column("covered").to_numpy()
        read = lambda t, c: np.frombuffer(b"".join(x.as_py() for x in t.column(c)), BLOB[c])
        early = table.filter(pa.array(done))
        gone = [[read(early, c) for c in ("ord", "tkey", "lo", "size")]]
        table = table.filter(pa.array(~done))
        key = read(table, "key")
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)] if len(key) else order
        wanted = []
        if len(order):
            ord_, tkey, lo, size, whole, core = (read(table, c)[order] for c in ("ord", "tkey", "lo", "size", "whole", "core"))
            key = key[order]
            order = np.lexsort((ord_, whole, key))
            ord_, tkey, lo, size, whole, core, key = (x[order] for x in (ord_, tkey, lo, size, whole, core, key))
            anchor = np.append(True, key[1:] != key[:-1])
            string = anchor | np.append(True, whole[1:] != whole[:-1])
            first = ord_[np.flatnonzero(string)][np.cumsum(string) - 1]
            later = ord_ > first
            gone.append([x[later] for x in (ord_, tkey, lo, size)])
            kinds = np.add.reduceat(string.astype(np.int64), np.flatnonzero(anchor))[np.cumsum(anchor) - 1]
            least, most = (f.reduceat(first, np.flatnonzero(anchor))[np.cumsum(anchor) - 1] for f in (np.minimum, np.maximum))
            on = np.flatnonzero(~later & (kinds > 1) & (least < most))
            on = on[agreeing((np.cumsum(anchor) - 1)[on], first[on], core[on])]
            wanted = [by_document(False, ord_[on], tkey[on], lo[on], size[on], (np.int64(shard) << 32) | key[on].astype(np.int64))]
        return pa.concat_tables([by_document(True, *(np.concatenate(x) for x in zip(*gone, strict=True))), *wanted])

    blobs = rows.mapInArrow(run, "shard int, covered boolean, " + ", ".join(f"{c} binary" for c in BLOB))
    return blobs.groupBy("shard").applyInArrow(find, FOUND)


def covered_windows(parts: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, until): of strings with owners, the ranges covered by windows of `length` bytes that a string
    with a smaller owner has too: one suffix array over all of them."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(int(ends[-1]), np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1  # 0 ends each string
    of = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(raw)) + of
    text[place] = raw
    left = np.zeros(len(text), np.int64)  # bytes to the end of the string
    left[place] = ends[of] - 1 - place
    string = np.zeros(len(text), np.int64)
    string[place] = of
    sa = suffix_array(text)
    common = np.minimum(permuted_common_prefixes(text, sa), left)
    usable = sa[left[sa] >= length]
    # Suffixes too short for a window never stand between two equal windows.
    new = common[usable] < length
    new[0:1] = True
    runs = np.flatnonzero(new)
    if not len(usable):
        return usable, usable, usable
    least = np.minimum.reduceat(owners[string[usable]], runs)
    hit = np.sort(usable[np.repeat(least, np.diff(np.append(runs, len(usable)))) < owners[string[usable]]])
    cut = np.append(True, np.diff(hit) > 1)[: len(hit)]
    a, b = hit[cut], hit[np.append(cut[1:], True)[: len(hit)]] + length
    return string[a], a - begins[string[a]], b - begins[string[a]]


def _edges(rows: DataFrame, unique: list[str], found: DataFrame, length: int) -> DataFrame:
    """FOUND, covered: what suffix arrays find in the segments that `found` leaves to them."""
    wanted = found.where("NOT covered")
    total = wanted.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    lists = wanted.groupBy(unique).agg(F.collect_list(F.struct("lo", "size", "key")).alias("s"))
    lists = lists.select(*unique, *(F.flatten(f"s.{c}").alias(c) for c in ("lo", "size", "key")))
    kinds = {"ord": np.int64, "tkey": np.int64, "lo": np.int32, "size": np.int32}

    def dealt(held: list[tuple[np.ndarray, ...]], raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        *columns, key = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = (mixed(key.view(np.uint64)) % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cut))
        picks = [order[cut[s] : cut[s + 1]] for s in some]
        blobs = [[x[p].astype(k).tobytes() for p in picks] for x, k in zip(columns, kinds.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(b, pa.binary()) for b in blobs), pa.array([b"".join(raws[i] for i in p.tolist()) for p in picks], pa.binary())], ["shard", *kinds, "raw"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        raws: list[bytes] = []
        for batch in batches:
            ords, tkeys = (batch.column(i).to_numpy() for i in (0, 1))
            lo, size, key = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
            count = batch.column(3).value_lengths().to_numpy()
            at = 0
            for text, n in zip(batch.column(2), count.tolist(), strict=True):
                data = text.as_buffer().to_pybytes()
                raws += [data[a : a + k] for a, k in zip(lo[at : at + n].tolist(), size[at : at + n].tolist(), strict=True)]
                at += n
            held.append((np.repeat(ords, count), np.repeat(tkeys, count), lo, size, key))
            if len(raws) >= FLUSH:
                yield from dealt(held, raws)
                held, raws = [], []
        if raws:
            yield from dealt(held, raws)

    def solve(table: pa.Table) -> pa.Table:
        ord_, tkey, lo, size = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), k) for c, k in kinds.items())
        raw = b"".join(x.as_py() for x in table.column("raw"))
        ends = np.cumsum(size.astype(np.int64))
        seen: dict[bytes, int] = {}
        of = np.array([seen.setdefault(raw[b - n : b], len(seen)) for b, n in zip(ends.tolist(), size.tolist(), strict=True)])
        owners = np.full(len(seen), LAST)
        np.minimum.at(owners, of, ord_)
        string, a, b = covered_windows(list(seen), owners, length)
        # The ranges of a string hold wherever it occurs.
        first, last = np.searchsorted(string, of), np.searchsorted(string, of, "right")
        item = np.repeat(np.arange(len(of)), last - first)
        span = np.arange(len(item)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[item]
        return by_document(True, ord_[item], tkey[item], lo[item] + a[span], b[span] - a[span])

    strings = rows.join(lists, unique).select("ord", "tkey", "text", "lo", "size", "key")
    blobs = strings.mapInArrow(cut_out, "shard int, ord binary, tkey binary, lo binary, size binary, raw binary")
    return blobs.groupBy("shard").applyInArrow(solve, FOUND)


def repeated_spans(rows: DataFrame, unique: list[str], length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For rows of `numbered` with any: its unique columns and `s`, a list of lists of byte ranges (lo, size) covered by
    `length`-byte strings that also start in a document with a smaller id. Ranges may overlap."""
    ship_package(rows.sparkSession)
    found = stored(_compared(rows, length, gram))
    edges = _edges(rows, unique, found, length)
    covered = found.where("covered").unionByName(edges).groupBy(unique).agg(F.collect_list(F.struct("lo", "size")).alias("s"))
    spans = stored(covered.select(*unique, F.flatten("s.lo").alias("lo"), F.flatten("s.size").alias("size")))
    forgotten(found)
    return spans


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order, those that overlap or touch made one."""
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)] if len(a) else reach


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and kept, the bytes that stay.

    Null text counts as empty. A document without an id comes after all others; rows with the same id take nothing from
    each other. Ids are whole numbers; others raise an error. Judged on the input, so the first document to hold a string
    keeps it. An empty table gives no rows; other columns are ignored.
    """
    numbers, unique = numbered(docs, id_col, text_col)
    spans = repeated_spans(numbers, unique, length, gram)
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"
    arrow = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    @F.arrow_udf(kind)
    def cleaned(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, los, sizes in parts:
            ends = np.concatenate([[0], np.cumsum(los.value_lengths().fill_null(0).to_numpy())])
            a, size = los.flatten().to_numpy(), sizes.flatten().to_numpy()
            rows = []
            for k, t in enumerate(texts):
                data, out, at = t.as_buffer(), [], 0
                some = slice(ends[k], ends[k + 1])
                first, last = merged(a[some], a[some] + size[some])
                for x, y in zip(first.tolist(), last.tolist(), strict=True):
                    out.append(data[at:x])
                    at = y
                out.append(data[at:])
                rows.append((data.size, int((last - first).sum()), len(first), b"".join(map(memoryview, out))))
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(arrow)], [n for n, _ in arrow])

    rows = numbers.join(spans, unique, "left")
    own = F.when(F.col("ord") != LAST, F.col("ord")).cast(docs.schema[id_col].dataType)
    return rows.select(own.alias(id_col), cleaned("text", "lo", "size").alias("_x")).select(id_col, "_x.*")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, id_col, text_col, length).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
