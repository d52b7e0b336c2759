"""op7 against brute force."""

import hashlib
import random
import re

import pytest

from quillon.llm import lines, near
from tests.llm import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=7):
    nodes = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                nodes.setdefault(line, []).append((i is None, i or 0, k))
    names = list(nodes)
    sets = [{x[j : j + width] for j in range(max(1, len(x) - width + 1))} for x in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, x in enumerate(names):
        least[find(a)] = min(least.get(find(a), (True, 1e9, 0)), min(nodes[x]))
    return sorted((n, i, k, *least[find(a)][1:], (n, i, k) == least[find(a)]) for a, x in enumerate(names) for n, i, k in nodes[x])


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line int").repartition(3)
    return sorted((r.doc_id is None, r.doc_id or 0, r.line_no, r.component_id or 0, r.component_line, r.kept) for r in lines.fuzzy_lines(docs).collect())


@pytest.mark.parametrize("block", [256, 2])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(block)
    base = [awkward.words(rng, rng.randint(3, 30)) for _ in range(12)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice("xyz") + w[p + 1 :]
            text.append(rng.choice([w, w, awkward.words(rng, 5), " "]))
        rows.append((i, "\n".join(text)))
    assert found(spark, rows) == brute(rows)


def test_awkward(spark):
    rows = list(dict.fromkeys((r[0], r[1]) for r in awkward.rows()))
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    docs = awkward.frame(spark, [r for r in awkward.rows() if r[0] is not None][:30])
    out = lines.drop_fuzzy_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert lines.line_report(docs).count() == docs.count()


def test_repeated_rows(spark):
    """Of lines of rows that repeat id and text, all or none stay."""
    rows = [(1, "a first line of words\nother things here"), (1, "a first line of words\nother things here"), (0, "a first line of wordz"), (2, "other things here")]
    got = found(spark, rows)
    assert got == sorted([(False, 0, 0, 0, 0, True), *[(False, 1, 0, 0, 0, False)] * 2, *[(False, 1, 1, 1, 1, True)] * 2, (False, 2, 0, 1, 1, False)])


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    data = [(1, "common line of words\nkeep this one please"), (1, "and keep me as well\ncommon line of words"), (None, "common line of words\nlast of all"), (2, None), (3, "")]
    got = lines.drop_fuzzy_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)
    first, second = sorted(data[:2], key=lambda r: hashlib.sha256(r[1].encode()).hexdigest())
    lost = "\n".join(x for x in second[1].split("\n") if x != "common line of words")
    assert texts == sorted([(False, 1, first[1]), (False, 1, lost), (False, 2, ""), (False, 3, ""), (True, 0, "last of all")])
    assert lines.drop_fuzzy_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_banding_by_length(spark):
    """Pairs of lines with similarity from 0.8 to 0.9, short and long: what share has a band in common."""
    import numpy as np

    from quillon.llm import shingles

    rng = random.Random(9)
    settings = lines.line_settings(lines.WIDTH, 80, 100)
    for length, edits in ((12, 1), (20, 1), (40, 1), (80, 1), (300, 4), (1500, 18)):
        tried = missed = 0
        for _ in range(3_000):
            a = awkward.words(rng, length)[:length]
            b = a
            for _ in range(edits):
                p = rng.choice([0, len(b) - 1, rng.randrange(len(b))])
                b = b[:p] + rng.choice(["", "q", "qq"]) + b[p + (rng.random() < 0.7) :]
            raw = [a.encode(), b.encode()]
            h, first = settings.shingle(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            x, y = set(h[: first[1]].tolist()), set(h[first[1] :].tolist())
            if 0.8 <= len(x & y) / len(x | y) < 0.93:
                tried += 1
                keys = settings.keys(settings.sketch(h, first))
                missed += not (keys[0] == keys[1]).any()
            if tried == 300:
                break
        assert tried >= 100 and missed <= 2, (length, tried, missed)
