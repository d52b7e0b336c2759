"""Hashing words and shingles of whole Arrow batches with numpy, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is hashed alone.
SLICE_BYTES = 300_000



def keep_freed_memory() -> bool:
    """Let this process keep what numpy frees, up to 64 MB, for its next arrays: by default the C library gives every
    large array back to the system, and touching new pages takes longer than computing on them. Linux only."""
    if not sys.platform.startswith("linux"):
        return False
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt"):
        return False
    mmap_threshold, trim_threshold = -3, -1  # fixed values of the C library
    return bool(libc.mallopt(mmap_threshold, 32 << 20) and libc.mallopt(trim_threshold, 64 << 20))


keep_freed_memory()

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
#: Bytes as they are hashed: upper-case letters as lower-case ones.
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] = LOWER[97:123]
_rng = np.random.default_rng(20_240_229)
#: Multipliers of the words of a shingle.
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary() if binary else pa.large_string()).fill_null(b"" if binary else "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and ODD**-i modulo 2**64, for i below n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 65_536)
        back = U64(pow(int(ODD), -1, 2**64))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, ODD))])
        _inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, back))])
    return _powers[:n], _inverse[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, first word of each text, with the number of words at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    # Each (byte, place in its word) has a random number of its own and a word the sum of its bytes' numbers, so words
    # that repeat a pattern are no likelier to collide than others.
    place = np.where(inside, np.arange(n) - starts[np.maximum(np.cumsum(inside & (~before | edge[:-1])) - 1, 0)], 0) if len(starts) else np.zeros(n, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(LOWER[data] + (place.astype(np.uint64) << U64(8)) + ODD), out=sums[1:])
    h = mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def word_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each text): the distinct `width`-word shingles of each text, in order of hash;
    with fewer words, the whole sequence as one; without words, none."""
    words, first = word_hashes(data, offsets)
    n = np.diff(first)
    total = len(words)
    if total >= width:
        full = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            full += words[k : total - width + 1 + k] * PLACE[k]
        full = mixed(full)
    out = []
    counts = np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            s = np.unique(full[a : b - width + 1])
        else:
            s = mixed(((words[a:b] * PLACE[: b - a]).sum(dtype=np.uint64) + U64(b - a))[None])
        counts[i] = len(s)
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


_POINT = mixed(np.arange(256, dtype=np.uint64) + ODD)
_STIR = [U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)]


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values, put together from those of runs of 1, 2, 4 ... values."""
    total = len(values) - width + 1
    run, size, out, done = values, 1, None, 0
    left = width
    while True:
        if left & 1:
            part = run[done : done + total]
            out = part if out is None else out * PLACE[size.bit_length()] + part
            done += size
        left >>= 1
        if not left:
            break
        run = run[:-size] * PLACE[16 + size.bit_length()] + run[size:]
        size *= 2
    out = out * _STIR[0]
    out ^= out >> U64(32)
    out *= _STIR[1]
    return out ^ (out >> U64(29))


def character_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every `width` consecutive code points of the texts, in no order and with repeats; a shorter text,
    if not empty, is one shingle."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if data.max() < 128:
        first, values = offsets.astype(np.int64), _POINT[data]
    else:
        points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        values = mixed(points.astype(np.uint64) + ODD)
    n = np.diff(first)
    total = len(values)
    owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if total >= width:
        whole = np.ones(total - width + 1, bool)  # the shingle lies in one text
        ends = (first[1:-1, None] - np.arange(1, width)).reshape(-1)
        whole[ends[(ends >= 0) & (ends < len(whole))]] = False
        owner = np.repeat(np.arange(len(n)), n)[: len(whole)][whole]
        hashes = _rolled(values, width)[whole]
    short = np.flatnonzero((n < width) & (n > 0))
    if len(short):
        alone = np.array([(values[first[i] : first[i + 1]] * PLACE[: n[i]]).sum(dtype=np.uint64) + U64(n[i]) for i in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, mixed(alone)])
    return owner, hashes


#: Bits of a hash that numbers to be sorted have room for, the upper ones; a slice's filled texts are numbered in the
#: others: fewer than 2**20 of them hold a byte.
SORT_BITS = 44


def character_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like `word_shingles`, over `width` consecutive code points; a shorter text is one shingle. All texts of a slice are
    sorted at once, by text and hash, and hashes have all their 64 bits."""
    text, hashes = character_windows(data, offsets, width)
    held = np.bincount(text, minlength=len(offsets) - 1) > 0
    filled, owner = np.flatnonzero(held), (np.cumsum(held) - 1)[text]
    packed = (owner.astype(np.uint64) << U64(SORT_BITS)) | (hashes >> U64(64 - SORT_BITS))
    order = np.argsort(packed)
    packed, owner, hashes = packed[order], owner[order], hashes[order]
    tied = packed[1:] == packed[:-1]
    if (tied & (hashes[1:] != hashes[:-1])).any():  # the lower bits decide
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        tied = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    fresh = np.append(True, ~tied)[: len(hashes)]
    counts = np.zeros(len(offsets) - 1, np.int64)
    counts[filled] = np.bincount(owner[fresh], minlength=len(filled))
    return hashes[fresh], np.concatenate([[0], np.cumsum(counts)])
