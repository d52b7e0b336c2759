"""The reducer of run events: messages, a tree of nodes and preview cards, kept as state of a stream or replayed over a table."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from itertools import repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.shared import ship_package
from quillon.streaming.runs import DELTAS

#: Kinds of content that are cards of their own, kinds of messages that are notes, states that end a run, and states of nodes
#: that are not over (fixed values).
CARDS = ("paper_list", "deep_read_report", "review")
NOTES = ("progress", "tool", "tool_hint")
TERMINAL = ("completed", "failed", "cancelled", "interrupted")
UNFINISHED = ("running", "pending", "cancel_requested")
#: What a node shows after its run has ended (fixed values).
SETTLED = {"cancelled": "已停止", "failed": "执行失败", "completed": "已完成"}

EVENT = {
    "run_id": "string", "arrival": "long", "at": "timestamp", "event": "string", "seq": "long", "turn_id": "string", "role": "string", "kind": "string", "content": "string",
    "content_kind": "string", "node_id": "string", "parent_id": "string", "title": "string", "status": "string", "input_tokens": "long", "output_tokens": "long",
    "metadata": "map<string,string>", "call_index": "int", "call_name": "string", "round": "int",
}
CHANGE = (
    "run_id string, item string, id string, version long, position long, parent_id string, turn_id string, role string, kind string, title string, content string, reasoning string, "
    "status string, streaming boolean, input_tokens long, output_tokens long, metadata map<string,string>"
)
_ARROW = {n: {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.map_(pa.string(), pa.string())) for n, t in (x.split() for x in CHANGE.split(", "))}
_FIELDS = list(_ARROW)
#: An event as the reducer reads it; a Row looks its fields up by name, one after the other.
Event = namedtuple("Event", EVENT, defaults=[None] * len(EVENT))
_HEAD = "mark long, items long, version long, status string, open string, turn string, place long, live boolean, thinking boolean"
_NODE = "place long, parent string, title string, status string, content string, input long, output long, below_input long, below_output long, children long, metadata map<string,string>"
_NODE_FIELDS = [x.split()[0] for x in _NODE.split(", ")]


def events(rows: DataFrame) -> DataFrame:
    """The fields of an event that `rows` has, for the others are null in `Event`; a stream's time always, a table's never."""
    has = lambda c: rows.isStreaming if c == "at" else c in rows.columns
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in EVENT.items() if has(c)])


class Run:
    """One run's state while a batch of its events is applied: loaded as needed, written back once. Each look at a state variable asks the JVM,
    so a run without a head, which has no other state either, isn't looked up; without `states` nothing is kept."""

    def __init__(self, states: dict[str, Any] | None, run_id: str) -> None:
        self.states, self.run_id = states, run_id
        self.known = states is not None and states["head"].exists()
        head = states["head"].get() if self.known else (0, 0, 0, "created", None, None, 0, False, False)
        self.mark, self.items, self.version, self.status, self.open, self.turn, self.place, self.live, self.thinking = head
        self.pieces: list[tuple[str, str]] | None = None  # of the open bubble, once it is looked at
        self.told = 0  # pieces that the state has already
        self.stale = False  # the open bubble has pieces that aren't shown
        self.nodes: dict[str, dict[str, Any]] = {}
        self.unfinished: set[str] = set()  # of the nodes
        self.all_nodes = not self.known  # whether `nodes` has all of the state's
        self.met: set[tuple[str, str]] = set()  # user turns and calls of this batch
        self.changed: dict[tuple[str, str], dict[str, Any]] = {}
        self.touched: set[str] = set()

    def clear_pieces(self) -> None:
        if self.states is not None:
            self.states["pieces"].clear()

    def first(self, name: str, key: str, value: tuple[Any, ...]) -> bool:
        """Whether a map of the state hasn't got the key, which it has from now on."""
        if (name, key) in self.met:
            return False
        self.met.add((name, key))
        if self.known and self.states[name].containsKey((key,)):
            return False
        if self.states is not None:
            self.states[name].updateValue((key,), value)
        return True

    # Nodes

    def node(self, id_: str) -> dict[str, Any]:
        """A node, made as a place-holder if a child comes before it."""
        if id_ not in self.nodes:
            if not self.all_nodes and self.states["nodes"].containsKey((id_,)):
                self.nodes[id_] = dict(zip(_NODE_FIELDS, self.states["nodes"].getValue((id_,)), strict=True))
            else:
                self.nodes[id_] = dict(zip(_NODE_FIELDS, (self.items, None, None, "running", None, 0, 0, 0, 0, 0, {}), strict=True))
                self.items += 1
                self.touched.add(id_)
            self.follow(id_)
        return self.nodes[id_]

    def follow(self, id_: str) -> None:
        (self.unfinished.add if self.nodes[id_]["status"] in UNFINISHED else self.unfinished.discard)(id_)

    def total(self, n: dict[str, Any]) -> tuple[int, int]:
        """A leaf's own tokens; of a node with children, theirs."""
        return (n["below_input"], n["below_output"]) if n["children"] else (n["input"], n["output"])

    def add_up(self, id_: str | None, more: tuple[int, int], children: int = 0) -> None:
        """Add to what is below a node, and carry the change of its total to its ancestors; a node met twice ends the walk."""
        seen: set[str] = set()
        while id_ and id_ not in seen and (more != (0, 0) or children):
            seen.add(id_)
            n = self.node(id_)
            before = self.total(n)
            n["below_input"], n["below_output"], n["children"] = n["below_input"] + more[0], n["below_output"] + more[1], n["children"] + children
            after = self.total(n)
            self.touched.add(id_)
            more, children, id_ = (after[0] - before[0], after[1] - before[1]), 0, n["parent"]

    def runtime_event(self, r: Event) -> None:
        id_ = (r.node_id or "").strip()
        if not id_:
            return
        n = self.node(id_)
        before, parent = self.total(n), r.parent_id or None
        n["title"], n["status"], n["content"] = r.title or n["title"], r.status or n["status"], r.content if r.content is not None else n["content"]
        n["metadata"] = dict(n["metadata"] or {}) | dict(r.metadata or {})  # a map comes as pairs
        n["input"] = max(0, r.input_tokens) if r.input_tokens is not None else n["input"]
        n["output"] = max(0, r.output_tokens) if r.output_tokens is not None else n["output"]
        self.touched.add(id_)
        self.follow(id_)
        after = self.total(n)
        if parent != n["parent"]:
            if n["parent"]:
                self.add_up(n["parent"], (-before[0], -before[1]), -1)
            n["parent"] = parent
            if parent:
                self.add_up(parent, after, 1)
        elif parent:
            self.add_up(parent, (after[0] - before[0], after[1] - before[1]))
        if n["status"] == "failed":
            self.status = "failed"
            self.close()
        elif n["status"] == "running" or (n["status"] == "completed" and self.status == "created"):
            self.status = "running"

    def settle(self) -> None:
        """Nodes that are not over take the run's end; only a run that has ended settles them."""
        if self.status not in TERMINAL:
            return
        end = self.status if self.status in ("cancelled", "failed") else "completed"
        if not self.all_nodes:
            for (id_,), _ in list(self.states["nodes"].iterator()):
                self.node(id_)
            self.all_nodes = True
        for id_ in self.unfinished:
            n = self.nodes[id_]
            n["status"], n["content"] = end, SETTLED[end]
            if end == "cancelled":
                n["metadata"] = dict(n["metadata"] or {}) | {"cancellation_reason": "user_requested"}
            self.touched.add(id_)
        self.unfinished.clear()

    # Messages

    def message(self, id_: str, place: int, **fields: Any) -> None:
        self.changed["message", id_] = {"position": place, **fields}

    def id_of(self, r: Event, kind: str) -> str:
        return f"msg:{r.turn_id or 'none'}:{kind}:{r.seq if r.seq and r.seq > 0 else 'pending'}"

    def single(self, r: Event, role: str, kind: str, id_: str | None = None) -> None:
        """A message that nothing is added to."""
        self.message(id_ or self.id_of(r, kind), self.items, role=role, kind=kind, content=r.content or "", turn_id=r.turn_id, streaming=False, metadata=dict(r.metadata) if r.metadata else None)
        self.items += 1

    def bubble(self, r: Event | None) -> list[tuple[str, str]]:
        """The pieces of the open bubble, which is opened if there is none."""
        if self.open is None:
            self.open, self.turn, self.place, self.pieces, self.told = self.id_of(r, "assistant"), r.turn_id, self.items, [], 0
            self.items += 1
            self.clear_pieces()
        elif self.pieces is None:
            self.pieces = [tuple(x) for x in self.states["pieces"].get()] if self.known and self.states["pieces"].exists() else []
            self.told = len(self.pieces)
        return self.pieces

    def show(self, live: bool) -> None:
        parts = lambda kind: "".join(t for k, t in self.pieces or [] if k == kind)
        self.message(self.open, self.place, role="assistant", kind="message", content=parts("content"), reasoning=parts("reasoning"), turn_id=self.turn, streaming=live)
        self.stale = False

    def add(self, r: Event, kind: str) -> None:
        self.bubble(r).append((kind, r.content or ""))
        self.live, self.thinking, self.status = True, self.thinking or kind == "reasoning", "running"
        self.stale = True

    def close(self) -> None:
        """The open bubble takes no more pieces."""
        if self.open is not None:
            self.bubble(None)
            self.show(False)
            self.clear_pieces()
        self.open, self.pieces, self.told, self.live, self.thinking = None, None, 0, False, False

    def message_event(self, r: Event) -> None:
        if r.content_kind in CARDS:
            self.single(r, "system", r.content_kind)
            self.status = "running"
        elif r.kind in NOTES:
            self.single(r, "system", r.kind)
            self.status = "running"
        elif r.role == "user":
            turn = r.turn_id or "none"
            if self.first("users", turn, (self.items,)):  # an echo confirms what is there
                self.single(r, "user", "message", f"user:{turn}")
        else:
            self.bubble(r)
            if r.content is not None:
                self.pieces = [x for x in self.pieces if x[0] != "content"] + [("content", r.content)]
                self.clear_pieces()
                self.told = 0
            self.live, self.status, self.stale = True, "running", True
            if r.content_kind == "text":
                self.close()

    def call_fragment(self, r: Event) -> None:
        """The first piece of a call that has a name opens its card, once."""
        name = (r.call_name or "").strip()
        if not name or r.call_index is None or r.call_index < 0:
            return
        if self.first("cards", f"{r.round or 0}/{r.call_index}", (name,)):
            self.changed["card", f"{name}_r{r.round or 0}_{r.call_index}"] = {"position": self.items, "kind": name, "turn_id": r.turn_id, "status": "running"}
            self.items += 1

    # All

    def apply(self, r: Event) -> None:
        """One event. Deltas at or below the highest number seen are replays; everything else passes and raises the mark."""
        if r.seq and r.seq > 0:
            if r.event in DELTAS and r.seq <= self.mark:
                return
            self.mark = max(self.mark, r.seq)
        if r.event == "runtime_event":
            self.runtime_event(r)
        elif r.event == "message":
            self.message_event(r)
        elif r.event in DELTAS:
            self.add(r, "content" if r.event == "delta" else "reasoning")
        elif r.event == "reasoning_end":
            self.thinking = False
        elif r.event == "call_fragment":
            self.call_fragment(r)
        elif r.event == "status":
            self.status = r.status or self.status
            if r.status and r.status not in ("running", "cancel_requested"):
                self.close()
        elif r.event == "error":
            self.single(r, "system", "error")
            self.status = "failed"
            self.close()
        elif r.event == "turn_end":
            self.status = r.status or self.status
            self.settle()
            self.close()

    def saved(self) -> Iterator[dict[str, Any]]:
        """Write the state back; the changes, each item once, in the order of position. Fields left out are null."""
        self.version += 1
        if self.stale:
            self.show(True)
        for id_ in self.touched:
            n = self.nodes[id_]
            if self.states is not None:
                self.states["nodes"].updateValue((id_,), tuple(n.values()))
            total = self.total(n)
            self.changed["node", id_] = {"position": n["place"], "parent_id": n["parent"], "title": n["title"], "status": n["status"], "content": n["content"], "input_tokens": total[0], "output_tokens": total[1], "metadata": dict(n["metadata"] or {})}
        if self.states is not None:
            if self.pieces is not None and len(self.pieces) > self.told:
                self.states["pieces"].appendList(self.pieces[self.told :])
            self.states["head"].update((self.mark, self.items, self.version, self.status, self.open, self.turn, self.place, self.live, self.thinking))
        self.changed["run", self.run_id] = {"position": -1, "status": self.status, "streaming": self.live}
        for (item, id_), fields in sorted(self.changed.items(), key=lambda x: (x[1]["position"], x[0])):
            yield {"run_id": self.run_id, "item": item, "id": id_, "version": self.version} | fields


class Reducer(StatefulProcessor):
    """A run's events to changes of its timeline. State: a value (the head), a list (pieces of the open bubble, appended to), and maps (nodes,
    user turns, cards). A run's state goes `grace` after its end, or `idle` after its last event, by a timer of the given clock; with the
    clock ProcessingTime it also has a time to live."""

    def __init__(self, clock: str, grace: int, idle: int) -> None:
        self.clock, self.grace, self.idle = clock, grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = 2 * self.idle if self.clock == "ProcessingTime" else None
        value, list_, map_ = (getattr(handle, f"get{k}State") for k in ("Value", "List", "Map"))
        self.states = {
            "head": value("head", _HEAD, ttl), "pieces": list_("pieces", "kind string, text string", ttl), "nodes": map_("nodes", "id string", _NODE, ttl),
            "users": map_("users", "turn string", "place long", ttl), "cards": map_("cards", "call string", "name string", ttl),
        }

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own = sorted((Event(**dict(zip(r.__fields__, r, strict=True))) for r in rows), key=lambda r: (r.arrival is None, r.arrival or 0))
        run = Run(self.states, key[0])
        for r in own:
            run.apply(r)
        for change in run.saved():
            yield Row(**dict.fromkeys(_FIELDS) | change)
        if self.clock != "None":
            times = [int(r.at.timestamp() * 1000) for r in own if r.at is not None]
            now = max([*times, timerValues.getCurrentWatermarkInMs()]) if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + (self.grace if run.status in TERMINAL else self.idle))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for s in self.states.values():
            s.clear()
        return iter(())

    def close(self) -> None:
        pass


def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of whole runs from events in the order of run and arrival, a run at a time; a run may go on in the next batch."""
    run, out = None, []
    for batch in batches:
        for r in map(Event._make, zip(*(_values(batch[c]) if c in batch.schema.names else repeat(None) for c in EVENT))):  # noqa: B905
            if run is None or run.run_id != r.run_id:
                out += run.saved() if run else ()
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
                run = Run(None, r.run_id)
            run.apply(r)
    if run:
        yield _batch([*out, *run.saved()])


def _values(column: pa.Array) -> list[Any]:
    """As to_pylist, which is slower, since it makes an Arrow scalar of each value; numpy has no whole numbers with nulls."""
    if pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _batch(changed: list[dict[str, Any]]) -> pa.RecordBatch:
    pairs = [list(x["metadata"].items()) if x.get("metadata") is not None else None for x in changed]
    return pa.RecordBatch.from_arrays([pa.array(pairs if n == "metadata" else [x.get(n) for x in changed], t) for n, t in _ARROW.items()], names=list(_ARROW))


#: The store whose state has several variables, timers and times to live.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes(rows: DataFrame, clock: str | None = None, grace: int = 600_000, idle: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Changes of the timelines of all runs: a row for each message, node, preview card and run that a batch of events touched, as it is after
    the batch, with a version that rises within the run. `rows` is a stream or a table; of a table all events of a run are one batch, in order
    of arrival, and no state is stored. Streams expire state by event time (`late` is the watermark's delay), or by the clock given; grace and idle are in milliseconds.

    Events without a run have no timeline. Null events and events of unknown kinds change nothing but the run's row; null content is
    empty text; a node whose id is null or blank is skipped; an event that repeats a node updates it, one that repeats a delta
    is dropped by its number, deltas without a number are never dropped. A node that names another parent moves. An empty table gives no rows."""
    spark = rows.sparkSession
    ship_package(spark)
    given = events(rows).where("run_id IS NOT NULL")
    if not rows.isStreaming:
        return given.repartition("run_id").sortWithinPartitions("run_id", F.asc_nulls_last("arrival")).mapInArrow(replay, CHANGE)
    spark.conf.set(*STORE)
    clock = clock or "EventTime"
    if clock == "EventTime":
        given = given.withWatermark("at", late)
    return given.groupBy("run_id").transformWithState(Reducer(clock, grace, idle), CHANGE, "Append", clock)


def current(changed: DataFrame) -> DataFrame:
    """The latest version of every item of every run."""
    rest = [c for c in changed.columns if c not in ("run_id", "item", "id")]
    latest = F.max_by(F.struct(*rest), "version").alias("x")
    return changed.groupBy("run_id", "item", "id").agg(latest).select("run_id", "item", "id", "x.*")
