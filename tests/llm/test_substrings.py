"""op4 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quillon.llm import substrings
from tests.llm import awkward


def brute(rows, length):
    """(id, text) rows -> counted (id, n_bytes, n_removed, n_spans, digest)."""
    data = [(2**63 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, b), (orig, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        out.append((-1 if orig is None else orig, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in substrings.digests(docs, **options).collect())


def passages(seed):
    rng = random.Random(seed)
    shared = [awkward.words(rng, rng.choice([6, 12, 40])) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(awkward.words(rng, rng.randint(0, 30)))
            p = rng.choice(shared)
            a = rng.randint(0, 20)
            parts.append(p[a:] if rng.random() < 0.5 else p)
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "flush", "heavy"), [(1, 500, 40), (2, 600_000, 3), (3, 300, 2)])
def test_against_brute_force(spark, monkeypatch, seed, flush, heavy):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", flush)
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rows = passages(seed)
    assert found(spark, rows) == brute(rows, 50)


def test_awkward(spark):
    rows = [(r[0], r[1]) for r in awkward.rows()] + [(500, "ab" * 400), (501, "ab" * 30 + "c"), (502, "\0" * 60), (503, "\0" * 70), (2, "same id " * 20), (2, "same id " * 21)]
    assert found(spark, rows) == brute(rows, 50)
    assert found(spark, []) == []


def test_segments_partition_the_windows():
    rng = random.Random(2)
    texts = [awkward.words(rng, k).encode() for k in (0, 3, 30, 500)] + [b"a" * 300]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, lo, size, _, _ = substrings.segments(data, offsets)
    for i, t in enumerate(texts):
        windows = sorted(p for a, n in zip(lo[doc == i], size[doc == i], strict=True) for p in range(a, a + n - 49))
        assert windows == list(range(len(t) - 49))
    frequent = np.unique(substrings.segments(data, offsets)[3])
    doc, lo, size, _, _ = substrings.segments(data, offsets, frequent=frequent)
    for i, t in enumerate(texts):
        windows = sorted(p for a, n in zip(lo[doc == i], size[doc == i], strict=True) for p in range(a, a + n - 49))
        assert windows == list(range(len(t) - 49))


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        substrings.digests(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("width", [1, 2, 3, 9, 27, 43])
def test_offset_ranges(width):
    assert [x for a, b in substrings.offset_ranges(width) for x in range(a, b + 1)] == list(range(width))


def bounds(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


@pytest.mark.parametrize(("length", "gram"), [(50, 24), (12, 12), (13, 12), (20, 3), (7, 2)])
def test_common_windows_have_a_common_part(length, gram):
    rng = random.Random(length)
    for trial in range(30):
        alphabet = rng.choice(["a", "ab", "abcdefgh "])
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 10, 60, 200]))).encode() for _ in range(5)]
        texts += [texts[0][3:] + texts[1], texts[2] * 2]
        frequent = np.unique(substrings.segments(*bounds(texts), length, gram)[3])[::2]
        for often in (None, frequent):
            held, strings = {}, {}
            for doc, lo, size, key, whole, core in zip(*substrings.segments(*bounds(texts), length, gram, often, cores=True), strict=True):
                string = texts[doc][lo : lo + size]
                assert strings.setdefault((key, whole), string) == string
                for p in range(size - length + 1):
                    held.setdefault(string[p : p + length], []).append((key, [(int(core) >> 10 * k) & 1023 for k in range(3)]))
            for of in held.values():
                key, parts = of[0]
                assert all(k == key and any(x and x == y for x, y in zip(parts, q, strict=True)) for k, q in of), trial


def test_segments_without_a_common_window_stay_out_of_the_arrays(spark):
    """Documents share 300 strings of 40 bytes and no window of 50: before, all segments with a common anchor went there."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [word(40) for _ in range(300)]
    rows = [(i, "".join(word(60) + s for s in shared)) for i in range(2)]
    keys = [set(k.tolist()) for k in (substrings.segments(*bounds([t.encode()]))[3] for _, t in rows)]
    assert len(keys[0] & keys[1]) > 150
    docs, unique = substrings.numbered(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    left = substrings._compared(docs, 50, 24).where("NOT covered").collect()
    assert sum(len(r["lo"]) for r in left) <= 10
    assert found(spark, rows) == brute(rows, 50)
