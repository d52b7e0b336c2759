"""op11 against plain Python, and the quickselect."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import importance
from tests.llm import awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (ns + 10000) / ((s[b] + 1.0) * (nt + 10000)))) for b in s}
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = len(able) * percent // 100
    want = Counter((r[0], r[2], r[3], r[4], n + 1 if n < k else None) for n, r in enumerate(able))
    return want + Counter((r[0], r[2], r[3], r[4], None) for r in out if r[1] < least)


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_resampling(spark, percent):
    docs = [(r[0], r[1]) for r in awkward.rows()]
    target = ["the river runs", None, "", "a b c 12 é漢 the THE", docs[13][1]]
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(awkward.frame(spark), bench, percent)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == brute(docs, target, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(awkward.frame(spark, []), none).count() == 0
    docs = [(r[0], r[1]) for r in awkward.rows()]
    got = importance.resample(awkward.frame(spark), none, 30)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == brute(docs, [], 30)


@pytest.mark.parametrize("most", [1, 7, 40])
def test_pieces(most):
    """Runs that cross the pieces of a long text are counted once each."""
    for row in awkward.rows():
        found = list(importance.buckets(row[1] or "", most))
        n, want = features(row[1])
        assert sum(f[0] for f in found) == n and Counter(b for f in found for b in f[1].tolist()) == Counter(want)


def test_kth_key(spark):
    rows = [(i % 7 * (i % 3), i if i % 11 else None) for i in range(400)] + [(5, 3)] * 200
    df = spark.createDataFrame(rows, "score long, id long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (1, 2, 37, 100, 250, 399, 600):
        assert importance.kth_key(df, k) == order[k - 1]
    assert importance.kth_key(df, 601) is None and importance.kth_key(df.limit(0), 1) is None


def test_drawn_rows_are_whole(spark):
    docs = awkward.frame(spark)
    bench = spark.createDataFrame([("a b c",)], "text string")
    got = importance.drawn(docs, bench, percent=50)
    assert got.columns == docs.columns
    want = {r[0] for r in importance.resample(docs, bench, 50).where("rank IS NOT NULL").select("doc_id").collect()}
    assert {r.doc_id for r in got.collect()} == want
