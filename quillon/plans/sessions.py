"""Registered queries of event logs, conversations and the session store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import context, eventlog, nested, retrieval
from quillon.shared import shared_folder
from quillon.sources.tables import LOG, derived, table
from quillon.streaming import runs, sinks, timeline

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


#: Purchases end turns, with a status by their event number.
STATUS = "CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN NULL ELSE 'completed' END"
#: Every event but the ends is a step of a stage.
STEP = f"SELECT session_id, turn, seq_no, ts AS created, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS completed, event_type AS stage, 'k' || CAST(event_id % 4 AS STRING) AS step_key, {STATUS} AS status, CASE WHEN event_id % 2 = 0 THEN 'error ' || CAST(event_id % 7 AS STRING) ELSE '' END AS content FROM log WHERE event_type <> 'purchase'"
TURNS = f"""log AS ({LOG}), t AS (SELECT session_id, turn, min_by(ts, seq_no) AS started, min_by(ts, seq_no) FILTER (WHERE event_type = 'purchase') AS ended,
arg_min_null({STATUS}, seq_no) FILTER (WHERE event_type = 'purchase') AS status FROM log GROUP BY session_id, turn HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0),
turns AS (SELECT *, date_diff('microsecond', started, ended) / 1e6 AS duration FROM t)"""


def log(spark, sf):
    return derived(spark, sf, LOG, "events").withColumn("status", F.expr(STATUS))


def ended(spark, sf):
    return eventlog.turns(log(spark, sf), "purchase")


def steps(spark, sf):
    return eventlog.steps(derived(spark, sf, LOG, "events").where("event_type <> 'purchase'").selectExpr("session_id", "turn", "seq_no", "ts AS created", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS completed", "event_type AS stage", "'k' || CAST(event_id % 4 AS STRING) AS step_key", f"{STATUS} AS status", "CASE WHEN event_id % 2 = 0 THEN 'error ' || CAST(event_id % 7 AS STRING) ELSE '' END AS content"))


@query("w06_f35_turns", f"WITH {TURNS} SELECT session_id, turn, started, ended, status, round(duration, 6) AS duration FROM turns")
def turns(spark, sf):
    return ended(spark, sf).select("session_id", "turn", "started", "ended", "status", F.round("duration", 6).alias("duration"))


@query("a15_turn_status", f"WITH {TURNS} SELECT CAST(ended AS DATE)::VARCHAR AS day, coalesce(status, 'unknown') AS status, count(*) AS turns FROM turns GROUP BY 1, 2")
def turn_status(spark, sf):
    return eventlog.status_counts(ended(spark, sf), [F.to_date("ended").cast("string").alias("day")])


@query(
    "a15_p19_traffic",
    f"WITH {TURNS} SELECT CASE WHEN session_id % 10 = 0 THEN 'eval' ELSE 'real' END AS traffic, coalesce(status, 'unknown') AS status, count(*) AS turns FROM turns GROUP BY 1, 2",
)
def traffic(spark, sf):
    title = F.when(F.col("session_id") % 10 == 0, F.concat(F.lit("eval_"), F.col("session_id").cast("string"))).when(F.col("session_id") % 10 == 1, F.lit("talk"))
    kind = F.when(F.coalesce(title.startswith("eval_"), F.lit(False)), "eval").otherwise("real")
    return eventlog.status_counts(ended(spark, sf), [kind.alias("traffic")])


@query(
    "a13_a15_rates",
    f"WITH {TURNS} SELECT count(*) AS turns, round(count(*) FILTER (WHERE status = 'completed') / count(*), 9) AS completed_rate, round(count(*) FILTER (WHERE status = 'cancelled') / count(*), 9) AS cancelled_rate, round(quantile_cont(duration, 0.5), 4) AS duration_p50, round(quantile_cont(duration, 0.95), 4) AS duration_p95 FROM turns",
)
def rates(spark, sf):
    r = eventlog.rates(ended(spark, sf))
    return r.select("turns", *[F.round(c, 9).alias(c) for c in ("completed_rate", "cancelled_rate")], *[F.round(c, 4).alias(c) for c in ("duration_p50", "duration_p95")])


_STEPS = f"""log AS ({LOG}), e AS ({STEP}), s AS (SELECT session_id, turn, step_key, min_by(stage, seq_no) AS stage, bool_or(coalesce(status = 'failed', false)) AS failed,
min_by(content, seq_no) FILTER (WHERE status = 'failed' AND content <> '') AS error, max_by(created, seq_no) AS created, max_by(completed, seq_no) FILTER (WHERE completed IS NOT NULL) AS completed, min(created) AS first_created, min(seq_no) AS first_seq
FROM e GROUP BY session_id, turn, step_key)"""


@query("a16_p18_steps", f"WITH {_STEPS} SELECT session_id, turn, step_key, stage, failed, error, created, completed FROM s")
def step_rows(spark, sf):
    return steps(spark, sf).select("session_id", "turn", "step_key", "stage", "failed", "error", "created", "completed")


@query(
    "a17_stage_stats",
    f"""WITH {_STEPS} SELECT stage, count(*) AS calls, count(*) FILTER (WHERE failed) AS failed, round(avg(failed::INT), 9) AS failure_rate,
round(coalesce(quantile_cont(date_diff('microsecond', created, completed) / 1e6, 0.95), 0), 4) AS duration_p95, round(coalesce(quantile_cont(date_diff('microsecond', first_created, completed) / 1e6, 0.95), 0), 4) AS true_p95 FROM s GROUP BY stage""",
)
def stage_stats(spark, sf):
    s = eventlog.stage_stats(steps(spark, sf))
    return s.select("stage", "calls", "failed", F.round("failure_rate", 9).alias("failure_rate"), F.round("duration_p95", 4).alias("duration_p95"), F.round("true_p95", 4).alias("true_p95"))


@query(
    "t05_top_errors",
    f"""WITH {_STEPS}, c AS (SELECT stage, substr(error, 1, 200) AS error, count(*) AS times, min((session_id, turn, first_seq)) AS f FROM s WHERE failed AND error IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY times DESC, f) AS place FROM c) SELECT stage, place::INT AS place, error, times FROM r WHERE place <= 3""",
)
def top_errors(spark, sf):
    return eventlog.top_errors(steps(spark, sf))


@query("a23_overall_success", f"WITH {_STEPS} SELECT round(1 - count(*) FILTER (WHERE failed) / count(*), 9) AS success FROM s")
def success(spark, sf):
    return eventlog.overall_success(eventlog.stage_stats(steps(spark, sf))).select(F.round("success", 9).alias("success"))


@query(
    "j11_retries",
    f"""WITH {TURNS} SELECT f.session_id, f.turn, m.turn AS other FROM turns f JOIN log m ON m.session_id = f.session_id AND m.turn <> f.turn AND m.event_type = 'view' AND m.ts > f.ended AND m.ts <= f.ended + INTERVAL 43200 SECOND
WHERE f.status = 'failed' GROUP BY 1, 2, 3""",
)
def retries(spark, sf):
    return eventlog.retried(ended(spark, sf).where("status = 'failed'"), log(spark, sf).where("event_type = 'view'"), 43_200)


@query(
    "a18_a19_a34_call_stats",
    """SELECT event_type AS operation, count(*) AS calls, round(avg((event_id % 4 > 1)::INT), 9) AS retry_rate, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS longest,
sum(CASE WHEN event_id % 3 = 0 THEN event_id % 100 ELSE event_id % 50 + 1 END)::BIGINT AS input, sum(event_id % 20)::BIGINT AS output FROM events GROUP BY event_type""",
)
def call_stats(spark, sf):
    calls = table(spark, sf, "events").selectExpr("event_type AS operation", "event_id % 4 AS attempts", "value AS duration_ms", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 + 1 END AS prompt_tokens", "event_id % 100 AS input_tokens", "CAST(NULL AS BIGINT) AS completion_tokens", "event_id % 20 AS output_tokens")
    s = eventlog.call_stats(calls)
    return s.select("operation", "calls", F.round("retry_rate", 9).alias("retry_rate"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "longest", "input", "output")


@query(
    "a21_j12_attempts",
    "WITH a AS (SELECT DISTINCT o_custkey AS s, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey), w AS (SELECT DISTINCT o_custkey AS s, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 25) SELECT count(*) AS attempts, round(avg((w.s IS NOT NULL)::INT), 9) AS success FROM a LEFT JOIN w ON a.s = w.s AND a.p = w.p",
)
def attempts(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("session_id"), F.col("l_partkey").alias("paper_id"), "l_quantity")
    return eventlog.attempt_success(rows, rows.where("l_quantity > 25")).select("attempts", F.round("success", 9).alias("success"))


@query(
    "s15_log_lines",
    """WITH l AS (SELECT event_id, (ts::VARCHAR) || ' | call done | ctx=' || CASE WHEN event_id % 6 = 0 THEN '{broken' ELSE props END AS line FROM events WHERE event_type <> 'error')
SELECT count(*) AS n, count(*) FILTER (WHERE line LIKE '%{broken') AS failed, sum(CASE WHEN line LIKE '%{broken' THEN NULL ELSE json_extract(regexp_extract(line, 'ctx=(.*)$', 1), '$.k')::BIGINT END)::BIGINT AS total FROM l""",
)
def log_lines(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(F.concat(F.col("ts").cast("string"), F.when(F.col("event_type") != "error", F.lit(" | call done | ctx=")).otherwise(" | other | ctx="), F.when(F.col("event_id") % 6 == 0, F.lit("{broken")).otherwise(F.col("props"))).alias("line"))
    calls = eventlog.parsed_calls(lines, "call done")
    return calls.agg(F.count("*").alias("n"), F.count_if(F.col("ctx").isNull()).alias("failed"), F.sum(F.try_variant_get("ctx", "$.k", "bigint")).alias("total"))


@query("p17_dotted_path", "SELECT event_id, 1 - (json_extract(props, '$.k')::DOUBLE) AS inverted FROM events")
def dotted(spark, sf):
    return table(spark, sf, "events").select("event_id", (1 - F.try_variant_get(F.try_parse_json("props"), "$.k", "double")).alias("inverted"))


_CONV = "FROM conversations"


@query("w08_turn_groups", "SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS grp FROM conversations")
def groups(spark, sf):
    return context.turn_numbers(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("group").alias("grp"))


@query(
    "w08_last_turns",
    "WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations), r AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY grp DESC) AS k FROM g) SELECT conv_id, turn FROM r WHERE k <= 2",
)
def last_turns(spark, sf):
    return context.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


@query(
    "w09_budget",
    """WITH c AS (SELECT *, sum(length(text) + 8) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, turn FROM c WHERE cost <= 300 OR n <= 2""",
)
def budget(spark, sf):
    c = table(spark, sf, "conversations")
    return context.within_budget(c, "conv_id", "turn", F.length("text") + 8, 300, 2).select("conv_id", "turn")


@query(
    "w10_tail_cut",
    """WITH c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
SELECT conv_id, turn, substr(text, 1, (250 - b)::BIGINT) AS text FROM c WHERE b < 250""",
)
def tail(spark, sf):
    return context.tail_with_cut(table(spark, sf, "conversations"), "conv_id", "turn", "text", 250).select("conv_id", "turn", "text")


@query(
    "w22_merged_messages",
    """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS n FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN role ELSE 'user' END AS r2 FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM l) SELECT conv_id, role, min(turn) AS first, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM s GROUP BY conv_id, run, role""",
)
def merged(spark, sf):
    return context.merged_messages(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "role", "first", "text")


@query("f23_token_estimate", "SELECT conv_id, turn, greatest(1, floor(length(text) / 4.5))::BIGINT AS tokens FROM conversations")
def tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.token_estimate(F.length("text")).alias("tokens"))


@query(
    "j21_call_pairs",
    f"""WITH log AS ({LOG}), c AS (SELECT session_id, seq_no AS pos, 'c' || (event_id % 6)::VARCHAR AS call_id, CASE WHEN event_type IN ('view', 'click') THEN 'call' ELSE 'response' END AS kind FROM log),
f AS (SELECT session_id, call_id, min(pos) AS called FROM c WHERE kind = 'call' GROUP BY 1, 2)
SELECT c.session_id, c.call_id, f.called, min(c.pos) AS answered FROM c JOIN f ON f.session_id = c.session_id AND f.call_id = c.call_id WHERE c.kind = 'response' AND c.pos > f.called GROUP BY 1, 2, 3""",
)
def call_pairs(spark, sf):
    rows = derived(spark, sf, LOG, "events").selectExpr("session_id", "seq_no AS pos", "'c' || CAST(event_id % 6 AS STRING) AS call_id", "CASE WHEN event_type IN ('view', 'click') THEN 'call' ELSE 'response' END AS kind")
    return context.repaired_calls(rows, "session_id", "pos")


@query(
    "a41_x11_folded_text",
    f"""WITH log AS ({LOG}), d AS (SELECT session_id, seq_no, CASE WHEN event_type = 'purchase' THEN 'message' ELSE 'delta' END AS kind, event_type || (event_id % 10)::VARCHAR AS t FROM log),
r AS (SELECT *, max(seq_no) FILTER (WHERE kind = 'message') OVER (PARTITION BY session_id) AS reset FROM d)
SELECT session_id, string_agg(t, '' ORDER BY seq_no) AS text FROM r WHERE reset IS NULL OR seq_no >= reset GROUP BY session_id""",
)
def folded(spark, sf):
    d = derived(spark, sf, LOG, "events").selectExpr("session_id", "seq_no", "CASE WHEN event_type = 'purchase' THEN 'message' ELSE 'delta' END AS kind", "event_type || CAST(event_id % 10 AS STRING) AS text")
    return context.folded(d, "session_id", "seq_no")


@query(
    "w02_w05_recent_events",
    "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, event_id, seq FROM r WHERE n <= 20",
)
def recent(spark, sf):
    e = table(spark, sf, "events")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("seq", seq.cast("long")).withColumn("n", n).where("n <= 20").select("user_id", "event_id", "seq")


@query(
    "x06_timeline_upsert",
    f"WITH log AS ({LOG}) SELECT session_id, event_id % 7 AS node, max_by(event_type, seq_no) AS event_type, max_by(value, seq_no) AS value, min(seq_no) AS first_seq FROM log GROUP BY 1, 2",
)
def timeline_upsert(spark, sf):
    rows = derived(spark, sf, LOG, "events")
    return rows.groupBy("session_id", (F.col("event_id") % 7).alias("node")).agg(F.max_by("event_type", "seq_no").alias("event_type"), F.max_by("value", "seq_no").alias("value"), F.min("seq_no").alias("first_seq"))


@query(
    "x08_settled_nodes",
    f"""WITH log AS ({LOG}), n AS (SELECT session_id, event_id % 7 AS node, max_by(event_type, seq_no) AS last FROM log GROUP BY 1, 2), e AS (SELECT session_id, max_by(event_type, seq_no) AS final FROM log GROUP BY 1)
SELECT n.session_id, node, CASE WHEN last = 'purchase' THEN 'completed' WHEN final = 'error' THEN 'failed' WHEN final = 'signup' THEN 'cancelled' ELSE 'completed' END AS status FROM n JOIN e USING (session_id)""",
)
def settled(spark, sf):
    rows = derived(spark, sf, LOG, "events")
    nodes = rows.groupBy("session_id", (F.col("event_id") % 7).alias("node")).agg(F.max_by("event_type", "seq_no").alias("last"))
    final = rows.groupBy("session_id").agg(F.max_by("event_type", "seq_no").alias("final"))
    status = F.when(F.col("last") == "purchase", "completed").when(F.col("final") == "error", "failed").when(F.col("final") == "signup", "cancelled").otherwise("completed")
    return nodes.join(final, "session_id").select("session_id", "node", status.alias("status"))


@query("a20_a39_workspace_totals", "SELECT o_orderstatus AS status, count(*) AS papers, count(DISTINCT o_custkey) AS sessions FROM orders GROUP BY 1")
def totals(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("papers"), F.count_distinct("o_custkey").alias("sessions"))


@query(
    "p05_t03_workspace_page",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 20",
)
def page(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice >= 100000 AND o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_totalprice")


@query(
    "k10_a04_upsert",
    "SELECT coalesce(a.doc_id, b.item_id) AS id, coalesce(nullif(a.text, ''), b.text) AS text, a.doc_id IS NULL AS is_new FROM documents a FULL JOIN benchmark b ON a.doc_id = b.item_id",
)
def upsert(spark, sf):
    old = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(True).alias("_there"))
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.upserted(old, new, "id", ["text"])


@query("k11_j07_delete_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade(spark, sf):
    gone = table(spark, sf, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(
    "a46_startup_repair",
    "SELECT CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'interrupted' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
)
def repair(spark, sf):
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 == 0), "interrupted").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "a35_tree_rollup",
    """WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_id = 0 THEN NULL ELSE event_id // 8 END AS parent FROM events),
leaf AS (SELECT id FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)),
up AS (SELECT id AS leaf, id AS node FROM leaf UNION SELECT up.leaf, t.parent FROM up JOIN t ON t.id = up.node WHERE t.parent IS NOT NULL)
SELECT node, sum(leaf % 10 + 1)::BIGINT AS tokens FROM up GROUP BY node""",
)
def rollup(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.expr("event_id div 8")).alias("parent"))
    level = t.join(t.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti").select("id", (F.col("id") % 10 + 1).alias("tokens"))
    found = level
    # A level at a time: sums move to the parents, so no pair of ancestor and leaf is made.
    for _ in range(64):
        level = level.join(t, "id").where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.sum("tokens").alias("tokens"))
        if level.limit(1).count() == 0:
            break
        found = found.unionByName(level)
    return found.groupBy(F.col("id").alias("node")).agg(F.sum("tokens").alias("tokens"))


@query(
    "w19_first_token",
    f"""WITH log AS ({LOG}), p AS (SELECT session_id, turn, min(ts) AS ts FROM log GROUP BY 1, 2), f AS (SELECT session_id, turn, min(ts) AS f FROM log WHERE event_type = 'click' GROUP BY 1, 2)
SELECT session_id, turn, greatest(date_diff('microsecond', p.ts, f.f) / 1e6, 0.001) AS delay FROM p JOIN f USING (session_id, turn)""",
)
def first_token(spark, sf):
    rows = derived(spark, sf, LOG, "events")
    posts = rows.groupBy("session_id", "turn").agg(F.min("ts").alias("ts"))
    return eventlog.first_token_delay(posts, rows.where("event_type = 'click'"))


@query(
    "a51_session_buckets",
    "WITH m AS (SELECT max(CAST(ts AS DATE)) AS today FROM events), s AS (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1) SELECT CASE WHEN d = today THEN 'today' WHEN d > today - 7 THEN 'week' ELSE 'earlier' END AS bucket, count(*) AS sessions FROM s, m GROUP BY 1",
)
def buckets(spark, sf):
    e = table(spark, sf, "events")
    today = e.agg(F.max(F.to_date("ts")).alias("today"))  # one row
    s = e.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("d")).join(F.broadcast(today))
    age = F.date_diff("today", "d")
    return s.groupBy(F.when(age == 0, "today").when(age < 7, "week").otherwise("earlier").alias("bucket")).agg(F.count("*").alias("sessions"))


@query(
    "x12_call_fragments",
    f"WITH log AS ({LOG}) SELECT session_id, event_id % 3 AS idx, string_agg(event_type, '' ORDER BY seq_no) AS arguments, min_by(event_type, seq_no) AS name FROM log GROUP BY 1, 2",
)
def fragments(spark, sf):
    rows = derived(spark, sf, LOG, "events")
    parts = rows.groupBy("session_id", (F.col("event_id") % 3).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("seq_no", "event_type"))).alias("x"))
    return parts.select("session_id", "idx", F.array_join(F.transform("x", lambda s: s["event_type"]), "").alias("arguments"), F.col("x")[0]["event_type"].alias("name"))


@query(
    "x05_x09_replayed_text",
    f"WITH log AS ({LOG}), f AS (SELECT session_id, seq_no // 2 AS seq, min_by(event_type, seq_no) AS c FROM log GROUP BY 1, 2) SELECT session_id::VARCHAR AS run_id, string_agg(c, '' ORDER BY seq) AS text FROM f GROUP BY 1",
)
def replayed(spark, sf):
    rows = derived(spark, sf, LOG, "events").selectExpr("CAST(session_id AS STRING) AS run_id", "seq_no AS arrival", "seq_no div 2 AS seq", "event_type AS content")
    return runs.replayed(rows)


@query("x03_stored_events", "SELECT event_type AS event, date_trunc('minute', ts)::VARCHAR AS start, count(*) AS n FROM events WHERE event_type NOT IN ('delta', 'reasoning_delta') GROUP BY 1, 2")
def stored_events(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("event"), F.col("event_id").alias("seq"), F.lit("").alias("content"), F.col("ts").alias("at"))
    return runs.windowed_counts(runs.to_store(runs.enveloped(e))).select("event", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


#: Run events from `events`: a run per user. Deltas come again with old numbers, nodes of a tree before their parents, assistant texts whole, call
#: fragments with and without names, and ends with a status.
RUN_EVENTS = f"""
SELECT CAST(session_id AS STRING) AS run_id, seq_no AS arrival, ts AS at, CAST(seq_no - event_id % 3 AS BIGINT) AS seq, 't' || CAST(turn AS STRING) AS turn_id,
       CASE event_type WHEN 'view' THEN 'delta' WHEN 'click' THEN 'runtime_event' WHEN 'signup' THEN 'message' WHEN 'purchase' THEN 'turn_end' ELSE 'call_fragment' END AS event,
       CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'user' ELSE 'assistant' END END AS role,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'text' END AS content_kind,
       CASE WHEN event_type IN ('view', 'signup') THEN substr(event_type, 1, 1) || CAST(event_id % 10 AS STRING) || ' ' END AS content,
       CASE WHEN event_type = 'click' THEN 'n' || CAST(event_id % 7 AS STRING) END AS node_id,
       CASE WHEN event_type = 'click' AND event_id % 7 > 0 THEN 'n' || CAST(floor(event_id % 7 / 2) AS INT) END AS parent_id,
       CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'running' END
            WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN NULL ELSE 'completed' END END AS status,
       CASE WHEN event_type = 'click' AND event_id % 4 > 0 THEN CAST(event_id % 100 AS BIGINT) END AS input_tokens,
       CAST(event_id % 3 AS INT) AS call_index, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'tool' || CAST(event_id % 4 AS STRING) END AS call_name, CAST(turn AS INT) AS round
FROM log
"""


def run_events(spark, sf):
    return spark.sql(RUN_EVENTS.replace("FROM log", "FROM {log}"), log=derived(spark, sf, LOG, "events"))


@query(
    "x05_x06_x07_x10_x13_run_timeline",
    f"""WITH RECURSIVE log AS ({LOG}), e AS ({RUN_EVENTS}),
m AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mark FROM e),
k AS (SELECT *, event = 'delta' OR (event = 'message' AND role = 'assistant') AS part, event = 'turn_end' OR (event = 'message' AND role = 'assistant' AND content_kind = 'text') AS closes
      FROM m WHERE NOT (event = 'delta' AND seq > 0 AND seq <= mark)),
g AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM k),
h AS (SELECT *, coalesce(max(arrival) FILTER (WHERE event = 'message') OVER (PARTITION BY run_id, grp), 0) AS whole, first_value(turn_id) OVER w AS t, first_value(seq) OVER w AS s FROM g WHERE part WINDOW w AS (PARTITION BY run_id, grp ORDER BY arrival)),
texts AS (SELECT run_id, grp, 'msg:' || t || ':assistant:' || CASE WHEN s > 0 THEN s::VARCHAR ELSE 'pending' END AS id, string_agg(content, '' ORDER BY arrival) FILTER (WHERE arrival >= whole) AS content FROM h WHERE part GROUP BY run_id, grp, t, s),
bubbles AS (SELECT run_id, 'message' AS item, id, NULL AS parent_id, max_by(content, grp) AS content, NULL AS status, NULL::BIGINT AS tokens FROM texts GROUP BY run_id, id),
users AS (SELECT run_id, 'message', 'user:' || turn_id, NULL, min_by(content, arrival), NULL, NULL FROM e WHERE event = 'message' AND role = 'user' GROUP BY run_id, turn_id),
cards AS (SELECT run_id, 'card', min_by(call_name, arrival) || '_r' || round || '_' || call_index, NULL, NULL, 'running', NULL FROM e WHERE event = 'call_fragment' AND call_name IS NOT NULL GROUP BY run_id, round, call_index),
came AS (SELECT run_id, node_id, max(arrival) AS last, max_by(status, arrival) AS status, max_by(parent_id, arrival) AS parent_id, coalesce(max_by(input_tokens, arrival) FILTER (WHERE input_tokens IS NOT NULL), 0) AS own FROM e WHERE node_id IS NOT NULL GROUP BY run_id, node_id),
n AS (SELECT run_id, node_id, last, status, parent_id, own FROM came UNION ALL
      SELECT run_id, parent_id, min(arrival), 'running', NULL, 0 FROM e WHERE parent_id IS NOT NULL AND (run_id, parent_id) NOT IN (SELECT run_id, node_id FROM came) GROUP BY run_id, parent_id),
ends AS (SELECT run_id, arrival, status FROM e WHERE event = 'turn_end'),
st AS (SELECT run_id, arrival, event, coalesce(CASE WHEN event = 'turn_end' THEN status END, NULL) AS given,
       CASE WHEN event = 'turn_end' THEN status WHEN event = 'delta' OR event = 'message' AND role = 'assistant' OR event = 'runtime_event' AND status = 'running' THEN 'running' END AS sets FROM k),
se AS (SELECT run_id, arrival, event, last_value(sets IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now FROM st),
te AS (SELECT run_id, arrival, now FROM se WHERE event = 'turn_end' AND now IN ('completed', 'failed', 'cancelled')),
settled AS (SELECT n.run_id, n.node_id, min_by(te.now, te.arrival) AS final FROM n JOIN te ON te.run_id = n.run_id AND te.arrival > n.last AND n.status = 'running' GROUP BY 1, 2),
leaf AS (SELECT run_id, node_id, own FROM n WHERE (run_id, node_id) NOT IN (SELECT run_id, parent_id FROM n WHERE parent_id IS NOT NULL)),
up AS (SELECT run_id, node_id AS leaf, own, node_id AS node FROM leaf UNION SELECT up.run_id, up.leaf, up.own, n.parent_id FROM up JOIN n ON n.run_id = up.run_id AND n.node_id = up.node WHERE n.parent_id IS NOT NULL),
total AS (SELECT run_id, node, sum(own)::BIGINT AS tokens FROM up GROUP BY 1, 2),
nodes AS (SELECT n.run_id, 'node', n.node_id, n.parent_id, NULL, coalesce(settled.final, n.status), total.tokens FROM n LEFT JOIN settled ON settled.run_id = n.run_id AND settled.node_id = n.node_id JOIN total ON total.run_id = n.run_id AND total.node = n.node_id)
SELECT * FROM bubbles UNION ALL SELECT * FROM users UNION ALL SELECT * FROM cards UNION ALL SELECT * FROM nodes""",
)
def run_timeline(spark, sf):
    rows = timeline.current(timeline.changes(run_events(spark, sf))).where("item <> 'run'")
    shown = F.when(F.col("item") == "message", F.col("content"))
    return rows.select("run_id", "item", "id", "parent_id", shown.alias("content"), F.when(F.col("item") != "message", F.col("status")).alias("status"), F.when(F.col("item") == "node", F.col("input_tokens")).alias("tokens"))


_MESSAGES = "SELECT conv_id AS session_id, conv_id * 1000 + turn AS id, turn AS created_at, text AS content, CASE turn % 5 WHEN 0 THEN 'out/' || role || '.md' WHEN 1 THEN '../' || role WHEN 2 THEN 'a/./b/../' || CAST(turn AS STRING) WHEN 3 THEN 'a/../../b' ELSE '/x//y' END AS path FROM conversations"


def stored_messages(spark, sf):
    """Three batches of messages in a new store, each run twice as after a crash."""
    import uuid

    store = sinks.Store(spark, f"{shared_folder(spark)}/quillon-store-{uuid.uuid4().hex}")
    rows = derived(spark, sf, _MESSAGES, "conversations")
    good, _ = sinks.artifacts(rows)
    for number, part in enumerate(("created_at < 2", "created_at BETWEEN 2 AND 3", "created_at > 3")):
        for _ in range(2):
            store.append(good.where(part), number)
    return store


_GOOD = f"""m AS ({_MESSAGES}), g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS seq_no,
CASE created_at % 5 WHEN 0 THEN path WHEN 2 THEN 'a/' || created_at ELSE 'x/y' END AS safe FROM m WHERE created_at % 5 NOT IN (1, 3))"""


@query("k01_k03_stored_once", f"WITH {_GOOD} SELECT session_id, id, seq_no, safe AS path, octet_length(encode(coalesce(content, '')))::BIGINT AS size FROM g")
def stored_once(spark, sf):
    return stored_messages(spark, sf).rows().select("session_id", "id", "seq_no", "path", "size")


@query("k02_stored_heads", f"WITH {_GOOD} SELECT session_id, max(seq_no) AS n, max_by(created_at, seq_no) AS last_at, max_by(substr(coalesce(content, ''), 1, 120), seq_no) AS summary FROM g GROUP BY session_id")
def stored_heads(spark, sf):
    return stored_messages(spark, sf).heads().select("session_id", "n", "last_at", "summary")


@query(
    "a22_reliability_report",
    f"""WITH {TURNS}, {_STEPS.replace(f"log AS ({LOG}), ", "")}, u AS (SELECT *, coalesce(status, 'unknown') AS st, CAST(ended AS DATE)::VARCHAR AS day, CASE WHEN session_id % 10 = 0 THEN 'eval' ELSE 'real' END AS traffic FROM turns),
g AS (SELECT stage, count(*) AS calls, count(*) FILTER (WHERE failed) AS failed, round(coalesce(quantile_cont(date_diff('microsecond', created, completed) / 1e6, 0.95), 0), 4) AS p95 FROM s GROUP BY stage),
k AS (SELECT stage, substr(error, 1, 200) AS error, count(*) AS times, min((session_id, turn, first_seq)) AS f FROM s WHERE failed AND error IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY times DESC, f) AS place FROM k),
x AS (SELECT stage, string_agg(error || ':' || times, ',' ORDER BY place) AS errors FROM r WHERE place <= 3 GROUP BY stage)
SELECT (SELECT count(*) FROM u) AS turns, (SELECT string_agg(st || ':' || n, ',' ORDER BY st) FROM (SELECT st, count(*) AS n FROM u GROUP BY 1)) AS statuses,
(SELECT string_agg(traffic || ':' || st || ':' || n, ',' ORDER BY traffic, st) FROM (SELECT traffic, st, count(*) AS n FROM u GROUP BY 1, 2)) AS traffic,
(SELECT string_agg(day || ':' || st || ':' || n, ',' ORDER BY day, st) FROM (SELECT day, st, count(*) AS n FROM u GROUP BY 1, 2)) AS days,
(SELECT round(count(*) FILTER (WHERE st = 'completed') / count(*), 9) FROM u) AS completed_rate, (SELECT round(quantile_cont(duration, 0.95), 4) FROM u) AS duration_p95,
(SELECT string_agg(g.stage || ':' || calls || ':' || failed || ':' || coalesce(errors, ''), ';' ORDER BY g.stage) FROM g LEFT JOIN x ON x.stage = g.stage) AS stages,
(SELECT round(sum(p95), 2) FROM g) AS p95_sum, (SELECT round(1 - sum(failed) / sum(calls), 9) FROM g) AS success""",
)
def report(spark, sf):
    step = "event_type <> 'purchase'"
    rows = derived(spark, sf, LOG, "events").selectExpr(
        "session_id", "CASE session_id % 10 WHEN 0 THEN concat('eval_', session_id) WHEN 1 THEN NULL ELSE 'talk' END AS title", "turn", "seq_no", "ts", "event_type", f"{STATUS} AS status",
        f"CASE WHEN {step} THEN event_type END AS stage", f"CASE WHEN {step} THEN 'k' || CAST(event_id % 4 AS STRING) END AS step_key", "CASE WHEN event_id % 2 = 0 THEN 'error ' || CAST(event_id % 7 AS STRING) ELSE '' END AS content",
        "ts AS created", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS completed",
    )
    r = nested.reliability(rows, "purchase")
    joined = lambda c, f, by=",": F.array_join(F.transform(c, f), by)
    text_ = lambda *c: F.concat_ws(":", *c)
    return r.select(
        "turns", joined(F.array_sort(F.map_entries("statuses")), lambda e: text_(e["key"], e["value"])).alias("statuses"), joined("traffic", lambda e: text_(e["name"], e["status"], e["turns"])).alias("traffic"),
        joined("days", lambda e: text_(e["name"], e["status"], e["turns"])).alias("days"), F.round("completed_rate", 9).alias("completed_rate"), F.round("duration_p95", 4).alias("duration_p95"),
        joined("stages", lambda e: text_(e["stage"], e["calls"], e["failed"], joined(e["errors"], lambda x: text_(x["error"], x["times"]))), ";").alias("stages"),
        F.round(F.aggregate("stages", F.lit(0.0), lambda a, e: a + F.round(e["p95"], 4)), 2).alias("p95_sum"), F.round("success", 9).alias("success"),
    )


_NESTED = """SELECT event_id, '{{"a": {{"paper_id": " p' || (event_id % 7) || ' "}}, "b": ["see [p' || (event_id % 5) || '] and [x y]", {{"paperIds": ["P' || (event_id % 3) || '", "q", null, 5]}}], "c": {{"d": {{"e": [[[{{"paperId": "deep' || (event_id % 4) || '"}}]]]}}}}, "n": 1, "z": ' || coalesce(props, 'null') || '}}' AS body FROM events"""


@query(
    "f46_nested_ids",
    """WITH l AS (SELECT event_id, ['p' || event_id % 7, 'p' || event_id % 5, 'x y', 'P' || event_id % 3, 'q', '5', 'deep' || event_id % 4] AS a FROM events),
e AS (SELECT event_id, unnest(a) AS id, unnest(range(len(a))) AS pos FROM l), f AS (SELECT event_id, min(pos) AS pos, min_by(id, pos) AS id FROM e GROUP BY event_id, lower(id))
SELECT event_id, string_agg(id, '|' ORDER BY pos) AS ids FROM f GROUP BY event_id""",
)
def nested_ids(spark, sf):
    rows = derived(spark, sf, _NESTED, "events").select("event_id", F.try_parse_json("body").alias("v"))
    return nested.ids_in(rows, "event_id", "v").select("event_id", F.array_join("ids", "|").alias("ids"))


_CAPTIONS = "SELECT user_id AS doc, event_id AS pos, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Fig. ' || CAST(event_id % 9 + 1 AS STRING) || ': x' WHEN 2 THEN 'Figure ' || CAST(event_id % 5 + 1 AS STRING) ELSE 'Figure IV. y' END AS caption FROM events WHERE event_id % 3 = 0"


@query(
    "w20_figure_numbers",
    f"""WITH RECURSIVE c AS (SELECT doc, pos, try_cast(regexp_extract(caption, '(?i)^fig(?:ure)?\\.?\\s*(\\d+)', 1) AS INT) AS n, row_number() OVER (PARTITION BY doc ORDER BY pos)::INT AS p FROM ({_CAPTIONS.replace("STRING", "VARCHAR")})),
r AS (SELECT doc, pos, p, coalesce(n, 1) AS figure, [coalesce(n, 1)] AS used FROM c WHERE p = 1
UNION ALL SELECT doc, pos, p, figure, list_append(used, figure) FROM (SELECT c.doc, c.pos, c.p, r.used, CASE WHEN c.n IS NOT NULL AND NOT list_contains(r.used, c.n) THEN c.n ELSE list_min(list_filter(range(c.p, 2 * c.p), lambda x: NOT list_contains(r.used, x::INT)))::INT END AS figure FROM r JOIN c ON c.doc = r.doc AND c.p = r.p + 1))
SELECT doc, pos, figure FROM r""",
)
def figure_numbers(spark, sf):
    rows = derived(spark, sf, _CAPTIONS, "events").withColumn("n", text.caption_number(F.col("caption")).try_cast("int"))
    return nested.figure_numbers(rows, "doc", "pos", "n")
