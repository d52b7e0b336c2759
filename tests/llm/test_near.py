"""op1 against brute force."""

import random
import re

import numpy as np
import pytest

from quillon.llm import near, setsketch, shingles
from quillon.llm.components import connected
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(id, text) rows -> {row number: smallest reachable row number}, linking sets by 100 i >= 85 u."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= 85 * max(len(sets[i]), len(sets[j])):
                k = len(sets[i] & sets[j])
                if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return sets, [find(i) for i in range(len(rows))]


def copies(rng, n):
    """Families of near copies at all distances around the threshold."""
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 20, 100, 400]))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
            base = rng.choice([base, w])
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_components_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = copies(random.Random(block), 40)
    rows = [(i, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, row string").repartition(3)
    rows.sort()
    sets, roots = brute(rows)
    got = {r.doc_id: r for r in near.near_dedup(docs).collect()}
    for i, (s, root) in enumerate(zip(sets, roots, strict=True)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root, root == i)


def test_a_bucket_of_exactly_a_step_of_pairs(spark, monkeypatch):
    """Linked in pairs only: 40 left rows meet 50 right ones, a step of pairs in one place, of which none may be left out."""
    monkeypatch.setattr(near, "STEP", 2_000)
    settings = near.word_settings(5, 85, 100)
    texts = [f"a{k} " * 2 + " ".join(f"w{k}_{j}" for j in range(60)) for k in range(40)]
    h, first = settings.shingle(*_bytes(texts))
    regs = np.ones((1, setsketch.REGISTERS), np.uint16)
    key = int(settings.keys(regs).view(np.int64)[0, 0])
    rows = [(1, 1, key, i, i, True) for i in range(40)] + [(1, 0, key, 100 + i, 100 + i, False) for i in range(50)]
    pool = [(r[3], 60, regs.tobytes(), texts[r[3] % 100] if r[3] % 100 < 40 else "other words that have no link at all " + str(r[3])) for r in rows]
    got = near._links_across(spark.createDataFrame(rows, "place long, side int, key long, cls long, root long, minor boolean"), 1, spark.createDataFrame(pool, "cls long, n long, regs binary, text string"), settings)
    assert {(r.a, r.b) for r in got.collect()} == {(i, 100 + i) for i in range(40)}


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_words_that_repeat_a_pattern_have_hashes_of_their_own():
    """Thue-Morse words and their complements: a sum of bytes times powers of one odd base is equal for them."""
    for size in (512, 1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        h, first = shingles.word_hashes(*_bytes([a, a.translate(str.maketrans("ab", "ba")), a.upper()]))
        assert h[0] != h[1] and h[0] == h[2] and first.tolist() == [0, 1, 2, 3]


def test_shared_keys(spark, monkeypatch):
    """Every class of a key that two classes or more have, however the classes are dealt to tasks and shards."""
    monkeypatch.setattr(near, "SHARD_KEYS", 500)
    monkeypatch.setattr(near, "FLUSH_KEYS", 200)
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 400, dtype=np.uint64)
    values = {c: rng.choice(keys[: 40 if c % 3 else 400], 4).astype(np.uint64) for c in range(600)}
    values |= {c: np.append(x[:3], keys[0]) for c, x in values.items() if c % 2}
    df = spark.createDataFrame([(c, x.tobytes()) for c, x in values.items()], "cls long, raw binary").repartition(3)
    got = {}
    for r in near.shared_keys(df, lambda raw: np.stack([np.frombuffer(x.as_py(), np.uint64) for x in raw]), 600, 4).collect():
        got.setdefault(r.key, set()).add(r.cls)
    want = {}
    for c, x in values.items():
        for k in x.tolist():
            want.setdefault(k, set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_awkward(spark):
    docs = awkward.frame(spark)
    rows = [(r[0], r[1]) for r in awkward.rows()]
    sets, roots = brute(rows)
    got = near.near_dedup(docs).collect()
    assert len(got) == len(rows)
    smallest = {}
    for (i, _), root in zip(rows, roots, strict=True):
        smallest[root] = min(smallest.get(root, 1e9), 1e9 if i is None else i)
    want = sorted((-1 if i is None else i, len(s), smallest[root]) for (i, _), s, root in zip(rows, sets, roots, strict=True))
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_shingles, 1e9 if g.component_id is None else g.component_id) for g in got) == want
    empty = sum(not s for s in sets)
    assert sum(g.kept for g in got) == len({r for r, s in zip(roots, sets, strict=True) if s}) + empty
    out = near.keep_one_of_each(docs)
    assert out.columns == docs.columns and out.count() == sum(g.kept for g in got)
    assert near.near_dedup(awkward.frame(spark, [])).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = 1000
        k = round(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
        regs = setsketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        both = setsketch.sketches(np.unique(np.concatenate([a, b])), np.array([0, len(np.unique(np.concatenate([a, b])))]))
        assert (np.maximum(regs[0], regs[1]) == both[0]).all()
        got = setsketch.estimates(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 5 * (share * (1 - share) / setsketch.REGISTERS) ** 0.5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in list(root)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
