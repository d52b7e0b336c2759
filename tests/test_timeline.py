"""The run reducer as a stream: restarts, expiry, order, and the cases of tool previews."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

from pyspark.sql import Row

from quillon.plans import sessions
from quillon.streaming import timeline

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 5, 1)
KINDS = ", ".join(f"{k} {v}" for k, v in timeline.EVENT.items())


def rows(spark, *given, first=1):
    """Events by dict, with arrival and time by their place."""
    full = [{k: None for k in timeline.EVENT} | {"run_id": "r", "arrival": i, "at": T0 + timedelta(seconds=i)} | g for i, g in enumerate(given, first)]
    return spark.createDataFrame([tuple(f[k] for k in timeline.EVENT) for f in full], KINDS)


def items(df):
    return {(r["run_id"], r["item"], r["id"]): r for r in timeline.current(df).collect()}


def drain(stream, at, **options):
    q = timeline.changes(stream, **options).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    return q


def test_stream_in_pieces_equals_replay(spark, tmp_path):
    """The events of a table in three batches, each from a restart, give what one replay gives."""
    table = sessions.run_events(spark, SF).cache()
    src = str(tmp_path / "in")
    os.makedirs(src)
    third = table.selectExpr("max(arrival) / 3").first()[0]
    stream = spark.readStream.schema(table.schema).parquet(src)
    for k in range(3):
        part = table.where((table.arrival > third * k) & (table.arrival <= third * (k + 1)))
        part.coalesce(2).write.mode("append").parquet(src)
        drain(stream, tmp_path, late="1000 days", grace=10**12, idle=10**12)
    got, want = items(spark.read.parquet(f"{tmp_path}/out")), items(timeline.changes(table))
    keep = [c for c in timeline._FIELDS if c not in ("version", "position")]
    assert set(got) == set(want) and len(got) > 50
    assert all([got[k][c] for c in keep] == [want[k][c] for c in keep] for k in want)


def test_messages(spark):
    text = lambda **x: {"event": "message", "role": "assistant", "turn_id": "t", **x}
    got = items(timeline.changes(rows(
        spark,
        {"event": "message", "role": "user", "turn_id": "t", "content": "ask", "seq": 1},
        {"event": "message", "role": "user", "turn_id": "t", "content": "ask", "seq": 1},  # an echo
        {"event": "reasoning_delta", "turn_id": "t", "content": "hm", "seq": 2},
        {"event": "delta", "turn_id": "t", "content": "ab", "seq": 3},
        {"event": "delta", "turn_id": "t", "content": "ab", "seq": 3},  # a replay
        {"event": "delta", "turn_id": "t", "content": "cd", "seq": None},
        {"event": "message", "kind": "message", "content_kind": "review", "turn_id": "t", "content": "card", "seq": 4},
        text(content="abcd!", content_kind="text", seq=5),
        {"event": "delta", "turn_id": "t", "content": "next", "seq": 6},
        {"event": "error", "turn_id": "t", "content": "broke", "seq": 7},
        {"event": "unheard of"}, {"event": None},
    )))
    said = sorted((r.position, r.id, r.role, r.content, r.reasoning, r.streaming) for k, r in got.items() if k[1] == "message")
    assert said == [
        (0, "user:t", "user", "ask", None, False), (1, "msg:t:assistant:2", "assistant", "abcd!", "hm", False), (2, "msg:t:review:4", "system", "card", None, False),
        (3, "msg:t:assistant:6", "assistant", "next", "", False), (4, "msg:t:error:7", "system", "broke", None, False),
    ]
    assert got["r", "run", "r"].status == "failed"


def test_children_before_parents_and_moves(spark):
    node = lambda i, p=None, **x: {"event": "runtime_event", "node_id": i, "parent_id": p, **x}
    got = items(timeline.changes(rows(
        spark,
        node("c", "p", input_tokens=5, status="completed", metadata={"a": "1", "b": "2"}),
        node("d", "p", input_tokens=7, output_tokens=1),
        node("p", "top", input_tokens=100, title="parent", status="running"),
        node("c", "p", input_tokens=6, metadata={"b": "3"}),
        node(" "), node(None),
        node("top", status="running"),
        node("x", "y", input_tokens=2), node("y", "x", input_tokens=3),  # a ring ends somewhere
        {"event": "turn_end", "status": "cancelled"},
    )))
    n = {k[2]: r for k, r in got.items() if k[1] == "node"}
    assert set(n) == {"c", "d", "p", "top", "x", "y"}
    assert (n["p"].input_tokens, n["p"].output_tokens, n["top"].input_tokens, n["c"].input_tokens) == (13, 1, 13, 6)
    assert n["c"].metadata == {"a": "1", "b": "3"} and n["c"].status == "completed"
    assert (n["d"].status, n["d"].content, n["d"].metadata) == ("cancelled", "已停止", {"cancellation_reason": "user_requested"}) and n["top"].status == "cancelled"
    moved = items(timeline.changes(rows(spark, node("c", "p", input_tokens=5), node("d", "p", input_tokens=1), node("c", "q"))))
    assert [moved["r", "node", i].input_tokens for i in ("p", "q", "c")] == [1, 5, 5]


def test_one_preview_card_a_call(spark):
    call = lambda i, name, n: {"event": "call_fragment", "call_index": i, "call_name": name, "round": n}
    given = [call(0, "search_papers", 1), call(0, None, 1), call(0, "search_papers", 1), call(1, "", 3), call(1, "deep_read_paper", 3), call(-1, "x", 1), call(None, "x", 1)]
    got = items(timeline.changes(rows(spark, *given)))
    assert sorted(k[2] for k in got if k[1] == "card") == ["deep_read_paper_r3_1", "search_papers_r1_0"]


def test_state_of_ended_runs_goes(spark, tmp_path):
    """An ended run's state goes a while after its end, a silent run's later; a run that goes on keeps its own."""
    src = str(tmp_path / "in")
    os.makedirs(src)
    delta = lambda run, at, seq, **x: {"run_id": run, "event": "delta", "content": "x", "seq": seq, "at": T0 + timedelta(minutes=at), **x}
    batches = [
        [delta("ended", 0, 1), {"run_id": "ended", "event": "turn_end", "status": "completed", "at": T0}, delta("silent", 0, 1), delta("lives", 0, 1)],
        [delta("lives", 30, 2)],
        [delta("lives", 60, 3)],
        [delta("lives", 600, 4)],
        [delta("lives", 601, 5)],
    ]
    stream = spark.readStream.schema(KINDS).parquet(src)
    left = []
    for b in batches:
        rows(spark, *b).coalesce(1).write.mode("append").parquet(src)
        q = drain(stream, tmp_path, grace=600_000, idle=7_200_000, late="1 minute")
        left.append([s.numRowsTotal for p in q.recentProgress for s in p.stateOperators])
    heads = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "head").load().collect()
    assert [r.key.run_id for r in heads] == ["lives"]
    assert heads[0].value.mark == 5


def test_a_table_needs_no_state_store(spark):
    """A table's runs are replayed from sorted events: nothing is asked of a state store, and a run goes on in the next batch of Arrow."""
    table = sessions.run_events(spark, SF).cache()
    want = items(timeline.changes(table))
    assert "TransformWithState" not in timeline.changes(table)._jdf.queryExecution().toString()
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert items(timeline.changes(table)) == want and len(want) > 50
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)


def test_a_new_run_is_not_looked_up(monkeypatch):
    """Of a run that has no head nothing else is asked; an echo isn't either, and an open bubble is put together once a batch."""
    asked, shown = [], []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *_: asked.append((self.name, call))

    show = timeline.Run.show
    monkeypatch.setattr(timeline.Run, "show", lambda self, live: (shown.append(live), show(self, live))[1])
    event = lambda i, **x: Row(**{k: None for k in timeline.EVENT} | {"run_id": "r", "arrival": i} | x)
    run = timeline.Run({n: State(n) for n in ("head", "pieces", "nodes", "users", "cards")}, "r")
    for i in range(100):
        run.apply(event(i, event="delta", content="x", seq=i + 1, turn_id="t"))
        run.apply(event(i, event="message", role="user", content="ask", turn_id="t"))
        run.apply(event(i, event="runtime_event", node_id="n", status="running", input_tokens=i))
        run.apply(event(i, event="call_fragment", call_index=0, call_name="tool", round=1))
    assert len(list(run.saved())) == 5 and shown == [True]
    assert sorted(asked) == [("cards", "updateValue"), ("head", "exists"), ("head", "update"), ("nodes", "updateValue"), ("pieces", "appendList"), ("pieces", "clear"), ("users", "updateValue")]


def test_workers_need_no_installed_package(tmp_path):
    """From another folder, in a session of its own, with the package on the driver's path only."""
    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.executor.memory", "1g").getOrCreate()
from quillon.operators import chunks
from quillon.sources import payloads
from quillon.streaming import timeline
import json
docs = spark.createDataFrame([(1, "# a\\n\\nsome text")], "doc_id long, text string")
pages = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
events = spark.createDataFrame([("r", 1, "delta", "x")], "run_id string, arrival long, event string, content string")
print(json.dumps([chunks.packed_blocks(docs).count(), payloads.html_blocks(pages).count(), timeline.changes(events).count()]))
"""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", code, top], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert json.loads(done.stdout.strip().splitlines()[-1]) == [1, 1, 2], done.stderr[-2000:]
