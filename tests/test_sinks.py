"""The session store: replays after a crash, numbering across batches and streams, summaries, safe paths."""

import os
import posixpath
from collections import defaultdict

import pytest

from quillon.streaming import sinks

KINDS = "session_id string, id string, created_at long, content string"


def batch(spark, rows):
    return spark.createDataFrame(rows, KINDS)


def stored(store):
    return sorted((r.session_id, r.seq_no, r.id) for r in store.rows().collect())


FIRST = [("a", "a1", 1, "x" * 200), ("a", "a2", 2, "two"), ("b", "b1", 1, None), (None, "lost", 1, "x")]
SECOND = [("b", "b2", 3, "bee"), ("a", "a3", 3, "three"), ("c", "c1", 3, "sea")]


def test_two_batches_and_replays(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    assert store.rows() is None and store.heads() is None
    assert store.append(batch(spark, FIRST), 0, jsonl=True) and not store.append(batch(spark, FIRST), 0)
    assert store.append(batch(spark, SECOND), 1, jsonl=True) and not store.append(batch(spark, SECOND[:1]), 1)
    want = [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1"), ("b", 2, "b2"), ("c", 1, "c1")]
    assert stored(store) == want
    assert sorted((r.session_id, r.n, r.last_at, r.summary) for r in store.heads().collect()) == [("a", 3, 3, "three"), ("b", 2, 3, "bee"), ("c", 1, 3, "sea")]
    lines = spark.read.option("basePath", f"{tmp_path}/s/jsonl").json(f"{tmp_path}/s/jsonl/stream=*")
    assert sorted((r.session_id, r.seq_no, r.id) for r in lines.collect()) == want
    assert store.append(batch(spark, []), 2) and not store.append(batch(spark, FIRST), 2)
    assert stored(store) == want


@pytest.mark.parametrize("lost", ["heads", "ledger"])
def test_crash_before_the_ledger(spark, tmp_path, lost, monkeypatch):
    """A batch that was written but not entered isn't read, and its replay gives the same numbers."""
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    store.append(batch(spark, FIRST), 0)
    before = stored(store)
    real = spark.createDataFrame

    def broken(*a, **k):
        raise RuntimeError("the driver died")

    df = batch(spark, SECOND)
    with monkeypatch.context() as m:
        if lost == "ledger":
            m.setattr(type(spark), "createDataFrame", broken)
        else:
            m.setattr(sinks, "SUMMARY", "no number")  # fails between rows and heads
        with pytest.raises(Exception):
            store.append(df, 1)
    assert real is not broken and stored(store) == before
    assert store.append(df, 1) and len(stored(store)) == 6
    numbers = defaultdict(list)
    for s, n, _ in stored(store):
        numbers[s].append(n)
    assert all(n == list(range(1, len(n) + 1)) for n in numbers.values())


def test_streams_share_numbers_and_heads_fold(spark, tmp_path):
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    for n in range(3):
        store.append(batch(spark, [("a", f"x{n}", n, f"t{n}")]), n, "one")
        store.append(batch(spark, [("a", f"y{n}", n, f"u{n}")]), n, "two")
    assert [n for _, n, _ in stored(store)] == [1, 2, 3, 4, 5, 6]
    before = store.heads().collect()
    store.compacted()
    store.compacted()
    assert store.heads().collect() == before and len(stored(store)) == 6
    store.append(batch(spark, [("a", "z", 9, "z")]), 3, "one")
    assert stored(store)[-1] == ("a", 7, "z")


def test_stream_with_restart(spark, tmp_path):
    """A stream into the store, its last batch run twice as after a crash before the commit."""
    src = tmp_path / "in"
    os.makedirs(src)
    store = sinks.Store(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(KINDS).parquet(str(src))
    for n, rows in enumerate((FIRST, SECOND)):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(src))
        if n:
            os.remove(tmp_path / "cp/commits/0")  # the first batch wasn't committed
            for crc in (tmp_path / "cp/commits").glob(".0.crc"):
                os.remove(crc)
        q = stream.writeStream.foreachBatch(store.writer()).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert stored(store) == [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1"), ("b", 2, "b2"), ("c", 1, "c1")]


def test_safe_paths(spark):
    given = ["a/b.md", "/a//b/./c", "a\\b", "../x", "a/../../x", "a/..", "", ".", "..", None, "/..", "a/b/../c", "x/../../x/y", "..a/b", "a/../b/../../.."]
    df = spark.createDataFrame([(i, p, "é" if i else None) for i, p in enumerate(given)], "i int, path string, content string")
    good, refused = sinks.artifacts(df)

    def want(p):
        if p is None:
            return None
        t = posixpath.normpath(p.replace("\\", "/").lstrip("/")) if p else ""
        return None if t in ("", ".", "..") or t.startswith("../") else t

    assert {r.i: r.path for r in good.collect()} == {i: want(p) for i, p in enumerate(given) if want(p)}
    assert {r.i for r in refused.collect()} == {i for i, p in enumerate(given) if not want(p)}
    assert {r.i: r.size for r in good.collect()}[0] == 0 and {r.i: r.size for r in good.collect()}[1] == 2
