"""Ids in nested values, figure numbers, the report on odd logs, and subscriptions, against plain Python."""

import json
import os
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from quillon.operators import nested
from quillon.streaming import broker


def plain_ids(value):
    """Depth first, fields by name."""
    out = []

    def clean(x):
        return str(x).strip().strip('"').strip("'").strip()

    def walk(v, named=False):
        if isinstance(v, dict):
            for k in sorted(v):
                if k in nested.ID_KEYS and not isinstance(v[k], (dict, list)):
                    out.append(clean("" if v[k] is None else v[k]))
                elif k in nested.LIST_KEYS and isinstance(v[k], list):
                    out.extend(clean(x) for x in v[k] if x is not None and not isinstance(x, (dict, list)))
                else:
                    walk(v[k])
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, str):
            out.extend(clean(m) for m in re.findall(r"\[([^\[\]]+)\]", v))

    walk(value)
    seen, kept = set(), []
    for x in out:
        if x and x.lower() not in seen:
            seen.add(x.lower())
            kept.append(x)
    return kept


def test_nested_ids(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.choice(["text", "list", "object", "id", "ids", "number"]) if depth else rng.choice(["text", "number"])
        if kind == "text":
            return rng.choice(["see [a1] and [B2]", "[a1]", "plain", "[ 'q' ]", "", "[x] [X]"])
        if kind == "list":
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == "id":
            return {rng.choice(nested.ID_KEYS): rng.choice(["p1", " P1 ", "", '"p2"', 7, None]), "other": value(depth - 1)}
        if kind == "ids":
            return {rng.choice(nested.LIST_KEYS): rng.choice([["p3", "p1"], [None, "", "p4"], []])}
        return {f"k{i}": value(depth - 1) for i in range(rng.randint(0, 3))} if kind == "object" else rng.choice([1, 2.5, True, None])

    data = [value(7) for _ in range(120)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(data)] + [(900, None), (901, "broken {")], "i int, t string")
    got = {r.i: r.ids for r in nested.ids_in(df.select("i", F.try_parse_json("t").alias("v")), "i", "v").collect()}
    assert len(got) == 122 and got[900] == got[901] == []
    assert {i: got[i] for i in range(120)} == {i: plain_ids(v) for i, v in enumerate(data)}


def test_figure_numbers(spark):
    rng = random.Random(5)
    docs = {d: [rng.choice([None, 1, 2, 3, 5, 9]) for _ in range(rng.randint(1, 9))] for d in range(60)}
    want = {}
    for d, captions in docs.items():
        used = []
        for i, n in enumerate(captions):
            if n is None or n in used:
                n = i + 1
                while n in used:
                    n += 1
            used.append(n)
            want[d, i] = n
    df = spark.createDataFrame([(d, i, n) for d, x in docs.items() for i, n in enumerate(x)], "d int, i int, n int").repartition(5)
    assert {(r.d, r.i): r.figure for r in nested.figure_numbers(df, "d", "i", "n").collect()} == want


LOG = "session_id long, title string, turn long, seq_no long, ts timestamp, event_type string, status string, stage string, step_key string, content string, created timestamp, completed timestamp"


def test_report_of_odd_logs(spark):
    t = datetime(2024, 3, 1)
    empty = nested.reliability(spark.createDataFrame([], LOG), "end").first()
    assert (empty.turns, empty.statuses, empty.traffic, empty.days, empty.stages, empty.completed_rate, empty.success) == (0, {}, [], [], [], None, None)
    rows = [
        (1, "eval_1", 1, 1, t, "step", "failed", "a", "k", "bad", t, None), (1, "eval_1", 1, 2, t, "step", "done", "a", "k", "", t, t), (1, "eval_1", 1, 3, t, "end", None, None, None, None, None, None),
        (2, None, 1, 1, t, "step", None, "b", "", None, t, t), (2, None, 1, 2, t, "end", "completed", None, None, None, None, None), (2, None, 2, 3, t, "step", None, "b", "k", None, t, t),
    ]
    r = nested.reliability(spark.createDataFrame(rows, LOG), "end").first()
    assert r.turns == 2 and r.statuses == {"unknown": 1, "completed": 1} and r.completed_rate == 0.5
    assert [(x.name, x.status, x.turns) for x in r.traffic] == [("eval", "unknown", 1), ("real", "completed", 1)]
    assert [(x.stage, x.calls, x.failed, [e.error for e in x.errors]) for x in r.stages] == [("a", 1, 1, ["bad"]), ("b", 1, 0, [])] and r.success == 0.5


def test_late_subscriber(spark, tmp_path):
    """History and live events overlap; a subscriber that comes late, and one that restarts, get each event once."""
    kinds = {"stored": "run_id string, event string, event_id string, seq_no long, content string", "live": "run_id string, event string, event_id string, stream_seq long, content string"}
    for k in kinds:
        os.makedirs(tmp_path / k)
    put = lambda k, rows: spark.createDataFrame(rows, kinds[k]).coalesce(1).write.mode("append").parquet(str(tmp_path / k))
    put("stored", [("r", "message", "e1", 1, "a"), ("r", "tool", "e2", 2, "b"), ("s", "message", "f1", 1, "z"), (None, "x", "g", 1, "")])
    put("live", [("r", "delta", None, 1, "d1"), ("r", "message", "e1", 1, "a"), ("r", "tool", "e2", 3, "b"), ("r", "delta", None, 4, "d4"), ("r", "delta", None, 4, "d4")])

    def drain():
        streams = [spark.readStream.schema(kinds[k]).parquet(str(tmp_path / k)) for k in ("stored", "live")]
        q = broker.subscription(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((r.run_id, r.event, r.event_id or "", r.seq if r.event == "delta" else 0) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("r", "delta", "", 1), ("r", "delta", "", 4), ("r", "message", "e1", 0), ("r", "tool", "e2", 0), ("s", "message", "f1", 0)]
    assert drain() == first
    put("stored", [("r", "message", "e3", 3, "c"), ("r", "delta", None, 5, "never stored")])
    put("live", [("r", "message", "e3", 9, "c"), ("r", "delta", None, 4, "d4"), ("r", "delta", None, 10, "d10")])
    assert drain() == sorted([*first, ("r", "message", "e3", 0), ("r", "delta", "", 10)])
    rows = spark.createDataFrame([("r", "live", 1), ("r", "stored", 9), ("r", "stored", 2), ("r", "live", 0)], "run_id string, source string, seq long").coalesce(1)
    assert [(r.source, r.seq) for r in broker.in_order(rows).collect()] == [("stored", 2), ("stored", 9), ("live", 0), ("live", 1)]


def test_ids_come_together_once(spark):
    """One exchange by key, and no join with the keys; keys without ids, values and null keys keep their row."""
    rows = [(1, '{"paperIds": ["b", "B", "a"], "x": {"paperId": "A"}}'), (2, None), (3, "{"), (None, '{"paper_id": "n"}'), (4, '["[z] and [y]", "[Z]"]'), (5, "{}")]
    values = spark.createDataFrame(rows, "i long, body string").select("i", F.try_parse_json("body").alias("v"))
    found = nested.ids_in(values, "i", "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join LeftOuter" not in plan
    assert {r.i: r.ids for r in found.collect()} == {1: ["b", "a"], 2: [], 3: [], None: ["n"], 4: ["z", "y"], 5: []}
