"""Suffix arrays by induced sorting, and permuted common prefixes, vectorised over the buckets of a byte alphabet."""

from __future__ import annotations

import numpy as np

#: A reduced text with more names than this is sorted by doubling: inducing takes its buckets one after the other.
BASE = 256


def classified(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S type); the last is larger than the empty one after it."""
    n = len(text)
    s = np.zeros(n, bool)
    if n > 1:
        step = np.sign(np.diff(text))
        change = np.flatnonzero(step)
        s[: change.max(initial=-1) + 1] = np.repeat(step[change] > 0, np.diff(change, prepend=-1))
    return s


def _place(sa: np.ndarray, ends: np.ndarray, items: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put items, in their order, at the next free places of their characters' buckets, upwards or downwards."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    counts = np.bincount(c, minlength=len(ends))
    rank = np.arange(len(c)) - (np.cumsum(counts) - counts)[c]
    sa[ends[c] + step * rank] = items[order]
    ends += step * counts


def induced(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from the order of the leftmost-smaller ones (`seeds`, sorted).

    Buckets are taken in order of their character, each in waves: what a wave puts into its own bucket is the next wave.
    Every suffix is in one wave of each of the two passes, so the work is linear.
    """
    n = len(text)
    size = int(text.max()) + 1
    counts = np.bincount(text, minlength=size)
    tops = np.cumsum(counts)
    sa = np.full(n, -1, np.int64)
    text = text.astype(np.uint16) if size <= 1 << 16 else text  # numbers of 16 bits are sorted by radix
    chars = text[seeds]
    seeded = np.bincount(chars, minlength=size)
    by_char = seeds[np.argsort(chars, kind="stable")]
    first_seed = np.cumsum(seeded) - seeded
    heads = tops - counts
    # Larger suffixes, rising; the end of the text comes before all and induces the last suffix.
    _place(sa, heads, np.array([n - 1]), text[[n - 1]], 1)
    for c in np.flatnonzero(counts):
        done = tops[c] - counts[c]
        while done < heads[c]:
            wave = sa[done : heads[c]]
            done = heads[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            _place(sa, heads, before, text[before], 1)
        if seeded[c]:
            wave = by_char[first_seed[c] : first_seed[c] + seeded[c]]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            _place(sa, heads, before, text[before], 1)
    # Smaller suffixes, falling; they take the places of the seeds.
    tails = tops - 1
    larger_ends = heads
    for c in np.flatnonzero(counts)[::-1]:
        done = tops[c] - 1
        while done > tails[c]:
            wave = sa[tails[c] + 1 : done + 1][::-1]
            done = tails[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            _place(sa, tails, before, text[before], -1)
        wave = sa[tops[c] - counts[c] : larger_ends[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        _place(sa, tails, before, text[before], -1)
    return sa


def substring_names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of the substring from each of `lms` to the next one's start, both included; number of names): names follow
    the order, and equal substrings, compared character by character, have one name. ordered: lms by their substrings."""
    size = np.zeros(len(text), np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = -1  # reaches the end of the text and equals no other
    a, b = ordered[:-1], ordered[1:]
    same = (size[a] == size[b]) & (size[a] > 0)
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
        k += 1
        open_ = open_[size[a[open_]] > k]
    name = np.zeros(len(text), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int((~same).sum()) + 1


def doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text of names, by their first 1, 2, 4 ... names; only suffixes that are still tied are
    sorted again, so the work shrinks with every round."""
    n = len(names)
    order = np.argsort(names)
    rank = np.zeros(n + 1, np.int64)  # of a suffix: the first place its ties have in the order, counted from 1
    slots, key, k = np.arange(n), names[order], 1
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[order[slots]] = slots[new][np.cumsum(new) - 1] + 1
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return order
        tied = order[slots]
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + k, n)]
        by_key = np.argsort(key)
        order[slots], key, k = tied[by_key], key[by_key], 2 * k


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of `text` (small whole numbers) in order.

    Leftmost-smaller substrings are sorted by inducing from unsorted seeds and get names; where names repeat, the text
    of names, shorter by half at least, is sorted by the same function, or by doubling if its names are many, and its
    order of suffixes seeds the final pass.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    small = classified(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        rough = induced(text, small, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        names, count = substring_names(text, lms, rough[is_lms[rough]])
        lms = lms[np.argsort(names) if count == len(lms) else suffix_array(names) if count <= BASE else doubled(names)]
    return induced(text, small, lms)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By place in the text: how many characters its suffix shares with the suffix before it in the array.

    Where both suffixes are preceded by equal characters, the value is that of the place before less one; only the
    other places' suffixes are compared, character by character."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    at = np.flatnonzero((before[1:] > 0) & (before[:-1] >= 0)) + 1
    own[at] = text[at - 1] != text[before[at] - 1]
    place = np.flatnonzero(own & (before >= 0))
    shared = np.zeros(n, np.int64)
    padded = np.append(text, [-1, -2])
    other, k = before[place], 0
    while len(place):
        on = padded[np.minimum(place + k, n)] == padded[np.where(other + k < n, other + k, n + 1)]
        shared[place[~on]] = k
        place, other = place[on], other[on]
        k += 1
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.where(before >= 0, shared[last] - (np.arange(n) - last), 0)
