"""Registered queries of the paper library, the session store and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import identity, text
from quillon.operators import chunks, library
from quillon.plans.retrieval import KEYED, papers
from quillon.sources import payloads
from quillon.sources.tables import PAPERS, derived, table

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


#: Incoming records: every document again under another id, some with its DOI, spelt otherwise and some a year off.
_WANTED = "SELECT 'q' || CAST(ord AS STRING) AS id, '  ' || title || ' !' AS title, CASE WHEN ord % 4 = 0 THEN doi ELSE '' END AS doi, CAST(NULL AS STRING) AS arxiv_id, CASE WHEN ord % 6 = 0 THEN NULL ELSE year + CAST(ord % 2 AS INT) END AS year, source FROM records"
_NAMED = f"""{KEYED},
k AS (SELECT ord, id, year, t, list_filter([CASE WHEN d LIKE '10.48550/arxiv.%' THEN 'arxiv:' || regexp_replace(substr(d, 16), 'v\\d+$', '') WHEN d <> '' THEN 'doi:' || d END, CASE WHEN a <> '' THEN 'arxiv:' || a END], lambda x: x IS NOT NULL) AS names FROM papers),
w AS (SELECT 'q' || ord::VARCHAR AS wid, CASE WHEN ord % 6 = 0 THEN NULL ELSE year + (ord % 2)::INT END AS wyear,
      t, CASE WHEN ord % 4 = 0 THEN (CASE WHEN d LIKE '10.48550/arxiv.%' THEN 'arxiv:' || regexp_replace(substr(d, 16), 'v\\d+$', '') WHEN d <> '' THEN 'doi:' || d END) END AS name FROM papers),
s AS (SELECT w.wid, w.wyear, k.ord, k.id, k.year FROM w JOIN (SELECT *, unnest(names) AS n FROM k) k ON w.name = k.n GROUP BY ALL),
h AS (SELECT wid, wyear, ord, id, year, bool_or(strong) AS strong FROM (SELECT *, true AS strong FROM s UNION ALL SELECT w.wid, w.wyear, k.ord, k.id, k.year, false FROM w JOIN k ON w.t = k.t AND w.t <> '') GROUP BY ALL)"""


def _matched(spark, sf):
    records = derived(spark, sf, PAPERS, "documents")
    return spark.sql(_WANTED.replace("FROM records", "FROM {records}"), records=records), records


@query("j04_f05_first_match", f"WITH {_NAMED} SELECT wid, min_by(id, ord) AS id FROM h WHERE strong OR wyear IS NULL OR year IS NULL OR wyear = year GROUP BY wid")
def first_match(spark, sf):
    return library.first_match(*_matched(spark, sf))


@query(
    "j03_best_hit",
    f"""WITH {_NAMED}, g AS (SELECT wid, wyear, min(ord) FILTER (WHERE strong) AS s, min(ord) FILTER (WHERE NOT strong) AS t FROM h GROUP BY wid, wyear),
b AS (SELECT g.wid, CASE WHEN g.s IS NOT NULL THEN g.s WHEN wyear IS NULL OR k.year IS NULL OR wyear = k.year THEN g.t END AS o FROM g LEFT JOIN k ON k.ord = g.t)
SELECT b.wid, k.id FROM b JOIN k ON k.ord = b.o""",
)
def best_hit(spark, sf):
    return library.best_hit(*_matched(spark, sf))


@query("j08_u04_requested_split", "SELECT item_id AS doc_id, item_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS found FROM benchmark")
def requested(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return library.requested_split(asked, table(spark, sf, "documents").where("lang = 'en'"), "doc_id")


_ASKED = "[item_id, item_id * 3, item_id, item_id * 1000003]"


@query("j09_selection_in_order", f"SELECT a.item_id AS request, a.p::INT AS place, d.doc_id, d.lang FROM (SELECT item_id, unnest({_ASKED}) AS id, unnest(range(4)) AS p FROM benchmark) a JOIN documents d ON d.doc_id = a.id")
def selection(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), F.array("item_id", F.col("item_id") * 3, "item_id", F.col("item_id") * 1_000_003).alias("ids"))
    return library.selected(asked, table(spark, sf, "documents").select("doc_id", "lang"), "request", "ids", "doc_id").select("request", "place", "doc_id", "lang")


@query("j13_j22_session_titles", "SELECT o.o_orderkey, c.c_name AS title, n.n_name AS nation FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def session_titles(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    titles = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return o.join(titles, "key", "left").join(nations, "c_nationkey", "left").select("o_orderkey", "title", "nation")


@query(
    "j15_state_then_cache",
    "SELECT d.doc_id, coalesce(b.text, l.quality::VARCHAR) AS value, CASE WHEN b.text IS NOT NULL THEN 'state' WHEN l.quality IS NOT NULL THEN 'cache' END AS origin FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def state_then_cache(spark, sf):
    state = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("value"))
    cache = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return library.first_of(table(spark, sf, "documents").select("doc_id"), {"state": state, "cache": cache}, "doc_id", "value")


_REFS = "CASE doc_id % 4 WHEN 0 THEN 'c' || {s} || ':s0001' WHEN 1 THEN 'c' || {s} WHEN 2 THEN 'x' || {s} || ':s0002' ELSE 'nothing' || {s} END"


@query(
    "j16_chunk_owner",
    f"""WITH c AS (SELECT 'c' || doc_id::VARCHAR || ':s0001' AS chunk_id, 'p' || doc_id::VARCHAR AS paper_id FROM documents WHERE lang <> 'fr'),
r AS (SELECT doc_id, {_REFS.format(s='doc_id::VARCHAR')} AS ref FROM documents),
m AS (SELECT regexp_replace(chunk_id, ':s\\d+$', '') AS short, min(paper_id) AS paper_id FROM c GROUP BY 1)
SELECT r.doc_id, r.ref, coalesce(c.paper_id, m.paper_id, nullif(regexp_extract(r.ref, '^([^:#]+)[:#]', 1), '')) AS paper_id FROM r LEFT JOIN c ON c.chunk_id = r.ref LEFT JOIN m ON m.short = r.ref""",
)
def chunk_owner(spark, sf):
    d = table(spark, sf, "documents")
    s = "CAST(doc_id AS STRING)"
    chunks = d.where("lang <> 'fr'").selectExpr(f"'c' || {s} || ':s0001' AS chunk_id", f"'p' || {s} AS paper_id")
    return library.chunk_owner(d.selectExpr("doc_id", f"{_REFS.format(s=s)} AS ref"), chunks).select("doc_id", "ref", "paper_id")


_PARTS = "coalesce(text, '') || chr(10) || 'see Figure ' || {n} || ' and TABLE 2.' || chr(10) || 'fig. 12, Fig 1 and table 21'"


@query(
    "j20_t09_mentions",
    f"""WITH l AS (SELECT doc_id, string_split({_PARTS.format(n='(doc_id % 3)::VARCHAR')}, chr(10)) AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS paragraph, unnest(range(len(a))) AS pos FROM l),
m AS (SELECT DISTINCT doc_id, pos, paragraph, 'figure' AS kind, unnest(regexp_extract_all(paragraph, '(?i)\\bfig(?:ure|\\.)?\\s*(\\d+)', 1)) AS n FROM p UNION SELECT DISTINCT doc_id, pos, paragraph, 'table', unnest(regexp_extract_all(paragraph, '(?i)\\btable\\s*(\\d+)', 1)) FROM p),
f AS (SELECT DISTINCT doc_id, kind, number FROM documents, (VALUES ('figure', 1), ('figure', 2), ('table', 2)) v(kind, number)),
r AS (SELECT f.*, m.paragraph, row_number() OVER (PARTITION BY f.doc_id, f.kind, f.number ORDER BY m.pos) AS place FROM f JOIN m ON m.doc_id = f.doc_id AND m.kind = f.kind AND try_cast(m.n AS INT) = f.number)
SELECT doc_id, kind, number, place::INT AS place, md5(paragraph) AS paragraph FROM r WHERE place <= 2""",
)
def mentions(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", F.posexplode(F.split(F.expr(_PARTS.format(n="CAST(doc_id % 3 AS STRING)")), "\n", -1)).alias("pos", "paragraph"))
    figures = d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("number")) for k, n in (("figure", 1), ("figure", 2), ("table", 2))])))
    return library.mentions(figures, lines, 2).withColumn("paragraph", F.md5("paragraph"))


@query(
    "j25_folded_regions",
    "SELECT coalesce(r.l_orderkey, f.l_orderkey) AS page, coalesce(r.l_linenumber, f.n) AS number, r.l_partkey AS region, f.caption, r.l_partkey IS NULL AS made FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) r FULL JOIN (SELECT l_orderkey, l_linenumber + 2 AS n, max(l_comment) AS caption FROM (SELECT *, 'c' || l_suppkey::VARCHAR AS l_comment FROM lineitem) GROUP BY 1, 2) f ON r.l_orderkey = f.l_orderkey AND r.l_linenumber = f.n",
)
def folded(spark, sf):
    li = table(spark, sf, "lineitem")
    regions = li.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("number")).agg(F.max("l_partkey").alias("region"))
    figures = li.groupBy(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") + 2).alias("number")).agg(F.max(F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).alias("caption"))
    return library.folded(figures, regions, ["page", "number"]).select("page", "number", "region", "caption", "made")


@query(
    "j26_turn_assembly",
    """WITH m AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, max(turn) AS last FROM m GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN m.turn IS NOT NULL THEN c.turn ELSE l.last END AS shown_in FROM conversations c LEFT JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn LEFT JOIN l ON l.conv_id = c.conv_id""",
)
def assembly(spark, sf):
    c = table(spark, sf, "conversations")
    return library.assembled_turns(c.select("conv_id", "turn"), c.where("role = 'user'"), "conv_id", "turn").select("conv_id", "turn", "shown_in")


@query("w07_recent_history", "SELECT user_id, event_id, n::INT AS from_end FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def recent(spark, sf):
    return library.newest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id", "from_end")


@query(
    "w11_budgeted_notes",
    "SELECT conv_id, turn, omitted FROM (SELECT *, count(*) FILTER (WHERE upto > 900) OVER (PARTITION BY conv_id) AS omitted FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)) WHERE upto <= 900",
)
def notes(spark, sf):
    return library.within_budget(table(spark, sf, "conversations"), ["conv_id"], "turn", F.length("text"), 900).select("conv_id", "turn", "omitted")


@query(
    "w18_gap_groups",
    "SELECT o_custkey, o_orderkey, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS run FROM (SELECT *, coalesce((o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 500)::INT, 0) AS s FROM orders)",
)
def gaps(spark, sf):
    return library.gap_groups(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", 500).select("o_custkey", "o_orderkey", "run")


@query(
    "w23_previous_sections",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
c AS (SELECT conv_id, turn, back, CASE WHEN length(text) > lim THEN substr(text, 1, lim) || '…' ELSE text END AS text FROM (SELECT *, CASE WHEN back <= 2 THEN 300 ELSE 100 END AS lim FROM b)),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY back) AS upto FROM c)
SELECT conv_id, turn, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '…' ELSE text END AS text FROM s WHERE upto <= 600 OR back = 1""",
)
def sections(spark, sf):
    return library.previous_sections(table(spark, sf, "conversations"), "conv_id", "turn", "text", 300, 100, 600).select("conv_id", "turn", "text")


_WORDS = "[' ' || split_part(text, ' ', 1), lower(split_part(text, ' ', 1)), split_part(text, ' ', 2), '', lower(split_part(text, ' ', 2)) || ' ']"


@query(
    "a45_first_spellings",
    f"""WITH w AS (SELECT conv_id, turn, list_transform({_WORDS}, lambda x: trim(x)) AS a FROM conversations), u AS (SELECT conv_id, turn, unnest(a) AS x, unnest(range(5)) AS p FROM w),
f AS (SELECT conv_id, turn, min_by(x, p) AS x, min(p) AS p FROM u WHERE x <> '' GROUP BY conv_id, turn, lower(x))
SELECT w.conv_id, w.turn, coalesce(g.s, '') AS spellings FROM w LEFT JOIN (SELECT conv_id, turn, string_agg(x, '|' ORDER BY p) AS s FROM f GROUP BY 1, 2) g USING (conv_id, turn)""",
)
def spellings(spark, sf):
    first, second = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    values = F.array(F.concat(F.lit(" "), first), F.lower(first), second, F.lit(""), F.concat(F.lower(second), F.lit(" ")))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(library.first_spellings(values), "|").alias("spellings"))


@query(
    "a38_merged_batches",
    """WITH b AS (SELECT conv_id, turn, [role, 'r' || (turn % 3)::VARCHAR, 'x'] AS ids, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS text FROM conversations),
e AS (SELECT conv_id, turn, unnest(ids) AS one, unnest(range(3)) AS p FROM b), f AS (SELECT conv_id, one, min((turn, p)) AS pl FROM e GROUP BY 1, 2),
i AS (SELECT conv_id, string_agg(one, ',' ORDER BY pl) AS ids FROM f GROUP BY 1)
SELECT b.conv_id, i.ids, coalesce(string_agg('【第' || b.turn || '批】' || b.text, chr(10) ORDER BY b.turn) FILTER (WHERE trim(b.text) <> ''), '') AS text FROM b JOIN i USING (conv_id) GROUP BY b.conv_id, i.ids""",
)
def batches(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array("role", F.concat(F.lit("r"), (F.col("turn") % 3).cast("string")), F.lit("x")).alias("ids"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("text"))
    return library.merged_batches(c, "conv_id", "turn", "ids", "text").select("conv_id", F.array_join("ids", ",").alias("ids"), "text")


@query(
    "k01_a42_append_events",
    """WITH o AS (SELECT conv_id, conv_id * 1000 + turn AS id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq_no FROM conversations WHERE turn < 2),
n AS (SELECT conv_id, conv_id * 1000 + turn AS id, text FROM conversations WHERE turn >= 1 AND conv_id * 1000 + turn NOT IN (SELECT id FROM o)), l AS (SELECT conv_id, max(seq_no) AS last FROM o GROUP BY 1)
SELECT conv_id, id, text, seq_no FROM o UNION ALL SELECT n.conv_id, n.id, n.text, coalesce(l.last, 0) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.id) FROM n LEFT JOIN l ON l.conv_id = n.conv_id""",
)
def append(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    old = c.where("turn < 2").select("conv_id", "id", "text", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq_no"))
    return library.appended(old, c.where("turn >= 1").select("conv_id", "id", "text"), "conv_id", "id", "id")


@query(
    "k02_session_summaries",
    """WITH m AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations), s AS (SELECT DISTINCT conv_id FROM conversations UNION SELECT -1)
SELECT s.conv_id, max_by(substr(t, 1, 120), turn) FILTER (WHERE t <> '') AS summary, count(m.turn) AS n_messages FROM s LEFT JOIN m ON m.conv_id = s.conv_id GROUP BY s.conv_id""",
)
def summaries(spark, sf):
    c = table(spark, sf, "conversations")
    ids = c.select("conv_id").distinct().union(c.select(F.lit(-1).cast(c.schema["conv_id"].dataType)).limit(1))
    return library.with_summaries(ids, c, "conv_id", "turn", "role", "text").select("conv_id", "summary", "n_messages")


@query("k13_patched_fields", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS source, coalesce(l.toxic::VARCHAR, d.lang) AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def patched(spark, sf):
    patches = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"), F.col("toxic").cast("string").alias("lang"))
    return library.patched(table(spark, sf, "documents").select("doc_id", "source", "lang"), patches, "doc_id", ["source", "lang"])


_LIB = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'deep_read' ELSE 'evaluated' END AS status, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 100 AS INT) END AS score FROM documents"


@query("k12_purge", f"SELECT x.doc_id, x.doc_id IN (SELECT doc_id FROM labels) AS cached, CASE WHEN x.doc_id NOT IN (SELECT doc_id FROM labels) AND status = 'deep_read' THEN CASE WHEN score IS NOT NULL THEN 'evaluated' ELSE 'new' END ELSE status END AS status FROM ({_LIB}) x")
def purge(spark, sf):
    return library.purged(derived(spark, sf, _LIB, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "cached", "status")


@query("p14_p22_status", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'deep_read' WHEN l.toxic IS NOT NULL THEN 'evaluated' ELSE 'new' END AS status, l.toxic IS NOT NULL AS has_text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def statuses(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.select("doc_id", library.status(F.col("quality") == 1, F.col("toxic")).alias("status"), F.col("toxic").isNotNull().alias("has_text"))


@query("p23_tool_failures", "SELECT event_id, (event_type = 'error' AND coalesce(props, '') <> '') OR event_type = 'view' AS failed FROM events")
def failures(spark, sf):
    state = F.when(F.col("event_type") == "view", "download_failed").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", library.tool_failed(F.when(F.col("event_type") == "error", F.col("props")), state).alias("failed"))


_PANEL = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'evaluated' END AS status, doc_id % 2 = 0 AS starred, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 100 AS INT) END AS score, CAST(2000 + doc_id % 20 AS INT) AS year, doc_id AS added_at, source, lang FROM documents"


@query(
    "p24_t13_panel",
    f"""SELECT id, score, rank() OVER (PARTITION BY lang ORDER BY coalesce(score, -1) DESC)::BIGINT AS place FROM ({_PANEL}) WHERE status = 'evaluated' AND starred AND contains(lower(title || ' ' || lang || ' ' || coalesce(source, '')), 'en')""",
)
def panel(spark, sf):
    """Every row of the panel, with its place among those of its language: ranks come from counts of scores, not from sorted rows."""
    rows = derived(spark, sf, _PANEL, "documents").withColumns({"authors": F.array("lang", F.coalesce("source", F.lit(""))), "sources": F.array("source")})
    found = library.panel(rows, "evaluated", None, True, " EN ", "score")
    level = F.coalesce("score", F.lit(-1))
    counts = found.groupBy("lang", level.alias("level")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    above = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col("lang").alias("l"), "level", (above + 1).alias("place"))
    return found.join(places, F.col("lang").eqNullSafe(F.col("l")) & (level == F.col("level"))).select("id", "score", "place")


@query("p12_usable_chunks", "SELECT conv_id, count(*) FILTER (WHERE length(text) > 600 OR text IS NULL) = 0 AND count(*) FILTER (WHERE conv_id % 4 = 1 OR (conv_id % 4 = 2 AND turn = 1)) = 0 AS usable FROM conversations GROUP BY conv_id")
def usable(spark, sf):
    """A quarter of the conversations are of an older version, another has one row that is."""
    old = (F.col("conv_id") % 4 == 1) | ((F.col("conv_id") % 4 == 2) & (F.col("turn") == 1))
    c = table(spark, sf, "conversations").withColumn("version", F.when(old, 9).otherwise(10))
    return library.usable_chunks(c, "conv_id", "text", "version", 10, 600)


_CHECKS = {"has_text": "length(text) > 0", "short": "CASE WHEN role = 'user' THEN length(text) <= 200 END", "asks": "CASE WHEN role = 'user' THEN text LIKE '%?%' END"}


@query(
    "a29_assertions",
    " UNION ALL ".join(f"SELECT conv_id * 1000 + turn AS case_id, '{k}' AS name, {v} AS holds FROM conversations WHERE ({v}) IS NOT NULL" for k, v in _CHECKS.items()),
)
def assertions(spark, sf):
    c = table(spark, sf, "conversations").withColumn("case_id", F.col("conv_id") * 1000 + F.col("turn"))
    return library.assertions(c, {k: F.expr(v) for k, v in _CHECKS.items()})


@query(
    "a28_suite",
    f"""WITH c AS (SELECT conv_id * 1000 + turn AS case_id, turn % 5 <> 0 AS completed, CASE WHEN turn % 2 = 0 THEN (turn % 6)::DOUBLE END AS score FROM conversations), a AS ({O['a29_assertions']})
SELECT (SELECT count(*) FROM c) AS cases, round((SELECT avg(completed::INT) FROM c), 9) AS completed_rate, round((SELECT avg(score) FROM c), 9) AS score, count(*) AS assertions, round(avg(holds::INT), 9) AS assertion_rate FROM a""",
)
def suite(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), (F.col("turn") % 5 != 0).alias("completed"), F.when(F.col("turn") % 2 == 0, (F.col("turn") % 6).cast("double")).alias("score"))
    s = library.suite(c, assertions(spark, sf))
    return s.select("cases", "assertions", *[F.round(x, 9).alias(x) for x in ("completed_rate", "score", "assertion_rate")])


@query(
    "a31_faithfulness",
    "SELECT l_orderkey AS case_id, round(avg(v), 9) AS faithfulness, count(v) AS claims FROM (SELECT l_orderkey, CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) THEN 1.0::DOUBLE WHEN l_linenumber BETWEEN 1 AND 5 THEN l_linenumber::DOUBLE END AS v FROM lineitem) GROUP BY 1",
)
def faithfulness(spark, sf):
    claims = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("paper_id"), F.col("l_linenumber").alias("score"))
    known = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("paper_id"))
    return library.faithfulness(claims, known).select("case_id", F.round("faithfulness", 9).alias("faithfulness"), "claims")


@query(
    "a33_a48_costs",
    "SELECT model, input, output, round((input * (CASE model WHEN 'click' THEN 3.0 WHEN 'view' THEN 1.5 ELSE 2.0 END) + output * (CASE model WHEN 'click' THEN 9.0 WHEN 'view' THEN 4.0 ELSE 8.0 END))::DOUBLE / 1e6, 4) AS cost FROM (SELECT event_type AS model, sum(event_id % 1000)::BIGINT AS input, sum(event_id % 77)::BIGINT AS output FROM events GROUP BY 1)",
)
def costs(spark, sf):
    usage = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum(F.col("event_id") % 1000).alias("input"), F.sum(F.col("event_id") % 77).alias("output"))
    prices = spark.createDataFrame([("click", 3.0, 9.0), ("view", 1.5, 4.0)], "model string, input_price double, output_price double")
    return library.costs(usage, prices, (2.0, 8.0)).select("model", "input", "output", "cost")


@query("a47_chars_per_token", "SELECT conv_id, CASE WHEN r BETWEEN 1 AND 100 THEN r END AS ratio FROM (SELECT conv_id, round(sum(length(text)) / nullif(sum(turn * 30), 0), 3) AS r FROM conversations GROUP BY 1)")
def ratio(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.length("text").alias("chars"), (F.col("turn") * 30).alias("prompt_tokens"))
    return library.chars_per_token(c, "conv_id")


@query("u06_t11_latest", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest, count(DISTINCT day) AS days FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_orderdate AS day FROM orders UNION SELECT o_custkey, o_orderkey, o_orderdate, o_orderdate FROM orders WHERE o_totalprice > 1000) GROUP BY 1")
def latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    both = o.union(table(spark, sf, "orders").where("o_totalprice > 1000").select(o.columns)).distinct()
    return both.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.countDistinct("o_orderdate").alias("days"))


@query("t08_t04_reading_order", "SELECT l_orderkey AS page, l_linenumber AS box, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity, l_linenumber, l_partkey)::INT AS place FROM lineitem")
def reading_order(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_quantity", "l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), F.row_number().over(w).alias("place"))


@query("p08_plain_titles", f"WITH p AS ({PAPERS}) SELECT id, trim(regexp_replace(replace(coalesce(title, ''), '\"', ''), '\\s+', ' ', 'g')) AS title FROM p")
def titles(spark, sf):
    return derived(spark, sf, PAPERS, "documents").select("id", text.plain_title(F.col("title")).alias("title"))


_OUTLINE = "CASE doc_id % 6 WHEN 0 THEN 'Appendix A' WHEN 1 THEN '参考文献' WHEN 2 THEN '引言与背景' WHEN 3 THEN 'An INTRODUCTION' WHEN 4 THEN '致谢' ELSE 'Methods' END"


@query("p20_body_parts", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(lower({_OUTLINE} || ' ' || coalesce(text, '')), '摘要|abstract|引言|绪论|introduction|参考文献|references|bibliography')")
def body_parts(spark, sf):
    return table(spark, sf, "documents").where(text.is_body_part(F.expr(_OUTLINE), F.coalesce("text", F.lit("")))).select("doc_id")


@query("p21_evidence_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE 'b' END AS fields FROM documents")
def fields(spark, sf):
    x = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(" a"), F.lit("z"), F.lit("b"), F.lit("a "))).otherwise(F.array(F.lit("b"), F.lit(""), F.lit("b")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.allowed_fields(x, ["a", "b"]), ",").alias("fields"))


#: Documents with page marks, headings, tables, formulas and figures about their text.
_PAGED = "concat('<!-- page: 1 -->', chr(10), 'IV. Part', chr(10), chr(10), coalesce(text, ''), chr(10), chr(10), '<!--page:2-->', '2. Methods', chr(10), chr(10), ' $$x$$', chr(10), chr(10), '$a_1$', chr(10), chr(10), '![f](u)', chr(10), chr(10), '| a |', chr(10), '| b |', chr(10), chr(10), '3. lower', chr(10), chr(10), '5. Two', chr(10), 'lines')"


@query(
    "f17_block_kinds",
    rf"""WITH d AS (SELECT doc_id, {_PAGED} AS x FROM documents),
p AS (SELECT doc_id, unnest(string_split_regex(x, '<!--\s*page:\s*\d+\s*-->')) AS part, unnest(list_concat([0], list_transform(regexp_extract_all(x, '<!--\s*page:\s*(\d+)\s*-->', 1), lambda n: n::INT))) AS page FROM d),
b AS (SELECT doc_id, page, unnest(string_split(part, chr(10) || chr(10))) AS raw FROM p), t AS (SELECT doc_id, page, regexp_replace(raw, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS t FROM b)
SELECT doc_id, page, CASE WHEN t LIKE '$$%' THEN 'display_formula' WHEN t LIKE '|%' THEN 'table' WHEN t LIKE '![%' THEN 'figure' WHEN regexp_matches(t, '^([IVXLC]{{1,8}}\.\s+\S|\d+\.\s+[A-Z])') AND NOT contains(t, chr(10)) THEN 'heading'
WHEN regexp_full_match(t, '\$[^$\n]+\$') THEN 'inline_formula' ELSE 'paragraph' END AS kind, count(*) AS n, sum(length(t))::BIGINT AS chars FROM t WHERE t <> '' GROUP BY 1, 2, 3""",
)
def kinds(spark, sf):
    rows = chunks.blocks(table(spark, sf, "documents").select("doc_id", F.expr(_PAGED).alias("text")))
    return rows.groupBy("doc_id", "page", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_SAID = "concat(coalesce(text, ''), CASE doc_id % 3 WHEN 0 THEN ' It is 3.14 of 0.5. Next?! End.' WHEN 1 THEN '结果是0.5。很好！是吗？对' ELSE ' No end here' END)"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(
    "f22_snippets",
    rf"""WITH d AS (SELECT doc_id, {_STRIP.format(_SAID)} AS t FROM documents),
x AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([。！？])', '\1' || chr(1), 'g'), '([.!?])([\s\p{{Z}}]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {_STRIP.format("s")}), lambda s: s <> '') AS s FROM d),
y AS (SELECT doc_id, array_to_string(s[1:2], ' ') AS head, array_to_string(s[greatest(len(s) - 1, 1):], ' ') AS tail FROM x)
SELECT doc_id, {_STRIP.format("substr(head, 1, 240)")} AS head, {_STRIP.format("right(tail, 240)")} AS tail FROM y""",
)
def snippets(spark, sf):
    said = table(spark, sf, "documents").select("doc_id", F.expr(_SAID).alias("t"))
    return said.select("doc_id", text.neighbour_snippet(F.col("t"), False).alias("head"), text.neighbour_snippet(F.col("t"), True).alias("tail"))


@query("f24_markers", r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, '') || ' and  done 。', '[ \t]{2,}', ' ', 'g'), ' +([，。；、,.!！？])', '\1', 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents")
def markers(spark, sf):
    glued = F.concat(F.coalesce("text", F.lit("")), F.lit("[1706.03762:p0001:s0003] and [ a b:C0001 ]1706.03762:p0002:s0001 done [abc:c0001]。"))
    return table(spark, sf, "documents").select("doc_id", text.without_markers(glued).alias("text"))


@query("f26_years", "SELECT doc_id, (1900 + doc_id % 150)::INT AS year FROM documents WHERE 1900 + doc_id % 150 < 2100")
def years(spark, sf):
    y = (1900 + F.col("doc_id") % 150).cast("string")
    return table(spark, sf, "documents").select("doc_id", text.year_in(F.concat(F.lit("id 12019876, v3, "), y, F.lit("-05-01 / 2001"))).alias("year"))


@query(
    "f29_collapsed_paths",
    r"""WITH u AS (SELECT page_id, url, url || '/2502.20217v1/2502.20217v1/2502.20217v1/a/a/1.2/1.2/2401.00001/2401.00001?x=/b/b' AS long FROM pages), p AS (SELECT page_id, url, string_split(long, '/') AS p FROM u)
SELECT page_id, array_to_string(list_filter(p, lambda x, i: i = 1 OR x <> p[i - 1] OR NOT regexp_full_match(x, '\d{4}\.\d{4,5}(v\d+)?')), '/') AS collapsed,
regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') || 'img/x.png?a=../b#c' AS relative, regexp_extract(url, '^(https?:)', 1) || '//h/y' AS other_host FROM p""",
)
def paths(spark, sf):
    u = F.col("url")
    repeated = F.concat(u, F.lit("/2502.20217v1/2502.20217v1/2502.20217v1/a/a/1.2/1.2/2401.00001/2401.00001?x=/b/b"))
    return table(spark, sf, "pages").select("page_id", text.collapsed_path(repeated).alias("collapsed"), text.resolved_url(u, F.lit("../img/./x.png?a=../b#c")).alias("relative"), text.resolved_url(u, F.lit("//h/y")).alias("other_host"))


@query("f34_json_arguments", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def arguments(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.to_json(F.struct(F.col("props").alias("arguments"))))
    inner = F.coalesce(F.get_json_object(raw, "$.arguments"), raw)
    return table(spark, sf, "events").select("event_id", F.get_json_object(inner, "$.k").alias("k"))


@query("f41_page_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, '') || chr(10) || chr(10) || 'end', '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g'), ' ')) AS digest FROM documents")
def page_text(spark, sf):
    raw = F.concat(F.lit("\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" \t\r\n")), F.lit("\r\n\n\n\x00end  \n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.page_text(raw)).alias("digest"))


@query("f43_tool_results", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '… (' || length(text)::VARCHAR || ' characters)' ELSE text END AS shown FROM documents")
def tool_results(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.noted_cut(F.col("text"), 500).alias("shown"))


#: A head whose commands are to go, and what is left of it; a text without a backslash stays.
_TEX = [
    (r"\textbf{A \emph{b}} ", "A b "), (r"5\% of $\textbf{x}_i$, ", r"5% of $\textbf{x}_i$, "), (r"\href{http://a}{here} \href{http://c} {} \url{http://b} ", "here http://c http://b "),
    (r"\alpha \underline{u} \textnormal{n} \text {t} \textitx{k} ", r"\alpha \underline{u} n t \textitx{k} "), (r"\[\emph{m} \_\] \(\text{q}\) $$\mbox{z}$$ ", r"\[\emph{m} \_\] \(\text{q}\) $$\mbox{z}$$ "),
    (r"vs.\ new C:\Users\Admin \d{2,4} ", r"vs. new C:\Users\Admin \d{2,4} "),
]


@query("f10_plain_latex", "SELECT doc_id, md5('" + "".join(b for _, b in _TEX).replace("'", "''") + "' || replace(coalesce(text, ''), '$', '€')) AS digest FROM documents WHERE NOT contains(coalesce(text, ''), '\\')")
def latex(spark, sf):
    d = table(spark, sf, "documents").where(~F.coalesce("text", F.lit("")).contains("\\"))
    return d.select("doc_id", F.md5(text.plain_latex(F.concat(F.lit("".join(a for a, _ in _TEX)), F.replace(F.coalesce("text", F.lit("")), F.lit("$"), F.lit("€"))))).alias("digest"))


@query("f31_external_refs", f"WITH {KEYED} SELECT id, CASE WHEN d <> '' THEN d WHEN a <> '' THEN a WHEN regexp_matches(coalesce(cited_by::VARCHAR, ''), '^(\\d+|[Ww]\\d+)$') THEN cited_by::VARCHAR ELSE '' END AS ref FROM papers")
def external_refs(spark, sf):
    return papers(spark, sf).select("id", identity.external_ref(F.col("doi"), F.col("arxiv_id"), F.col("cited_by").cast("string")).alias("ref"))


@query("p15_f21_flags", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, 'IV' AS first_number, count(*) FILTER (WHERE line LIKE '|%') > 0 AS has_table FROM l GROUP BY doc_id")
def flags(spark, sf):
    d = table(spark, sf, "documents")
    caption = text.caption_number(F.concat(F.lit("Table iv. "), F.coalesce("text", F.lit(""))))
    return d.select("doc_id", caption.alias("first_number"), F.coalesce("text", F.lit("")).rlike(r"(?m)^\|").alias("has_table"))


@query(
    "s18_chunk_files",
    "SELECT doc_id, (doc_id % 12)::BIGINT AS version, 'c' || doc_id::VARCHAR AS chunk_id, md5(text) AS content, doc_id % 2 = 0 AS has_table, false AS has_math FROM documents WHERE doc_id % 5 > 0 AND coalesce(text, '') <> ''",
)
def chunk_files(spark, sf):
    """Files with a whole chunk, one without an id, one without content, and every fifth broken off."""
    d = table(spark, sf, "documents")
    whole = F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, True).alias("has_table"))
    bad = F.struct(F.lit(None).cast("string").alias("chunk_id"), F.lit("x").alias("content"), F.lit(True).alias("has_table"))
    bare = F.struct(F.lit("y").alias("chunk_id"), F.lit("").alias("content"), F.lit(True).alias("has_table"))
    body = F.to_json(F.struct((F.col("doc_id") % 12).alias("version"), F.array(whole, bad, bare).alias("chunks")))
    files = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.substring(body, 1, 30)).otherwise(body).alias("payload"))
    return payloads.chunk_rows(files).select("doc_id", "version", "chunk_id", F.md5("content").alias("content"), "has_table", "has_math")


@query(
    "s16_workspace_files",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'k' || c_custkey::VARCHAR END AS paper_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 2001 END AS year FROM customer WHERE c_custkey % 7 > 0",
)
def workspace_files(spark, sf):
    c = table(spark, sf, "customer")
    record = F.struct(F.when(F.col("c_custkey") % 3 == 0, "own").otherwise("").alias("paperId"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, "2001").otherwise("n.d.").alias("year"))
    body = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("k"), F.col("c_custkey").cast("string"))), F.array(record)).alias("papers")))
    files = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("{")).otherwise(body).alias("payload"))
    return payloads.workspace_papers(files)


@query("s20_cases", "SELECT p_partkey, 'q' || p_partkey::VARCHAR AS case_id, p_name AS query, false AS holdout FROM part WHERE p_partkey % 4 > 0")
def case_files(spark, sf):
    p = table(spark, sf, "part")
    one = F.struct(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("query"), F.when(F.col("p_partkey") % 4 == 0, True).alias("holdout"))
    none = F.struct(F.lit("").alias("id"), F.lit("no id").alias("query"), F.lit(False).alias("holdout"))
    return payloads.cases(p.select("p_partkey", F.to_json(F.array(one, none)).alias("payload")))


@query("s05_s06_related_edges", "SELECT o_orderkey AS seed, 1 AS place, 'p' || o_custkey::VARCHAR AS paper_id, coalesce(o_orderstatus, '') AS title FROM orders")
def related(spark, sf):
    entry = lambda i, t: F.struct(F.struct(i.alias("paperId"), t.alias("title")).alias("citedPaper"))
    body = F.to_json(F.struct(F.array(entry(F.lit(""), F.lit("none")), entry(F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"))).alias("data")))
    return payloads.related_edges(table(spark, sf, "orders").select(F.col("o_orderkey").alias("seed"), body.alias("payload")), "references")


@query("f09_f08_renumbered", "SELECT doc_id, replace(coalesce(text, ''), '[', '(') || ' as in [1] and [x](u) or [2], so.' AS text FROM documents")
def renumbered(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("["), F.lit("(")), F.lit(" as in [p1] and [x](u) or [10.1/B], so [gone].")).alias("text"))
    numbers = d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(n).alias("number")) for r, n in (("p1", 1), ("10.1/B", 2), ("other", 3))])))
    return library.renumbered(d, numbers)


@query(
    "f39_outline_tasks",
    "SELECT p_partkey, chapter, section, row_number() OVER (PARTITION BY p_partkey ORDER BY c, s)::INT AS place FROM (SELECT p_partkey, 'one' AS chapter, unnest([p_brand, p_type]) AS section, 0 AS c, unnest([0, 1]) AS s FROM part UNION ALL SELECT p_partkey, 'two', NULL, 1, 0 FROM part)",
)
def outline(spark, sf):
    chapter = lambda t, parts: F.struct(F.lit(t).alias("title"), parts.alias("parts"))
    both = F.array(chapter("one", F.array("p_brand", "p_type")), chapter("two", F.array().cast("array<string>")))
    return library.outline_tasks(table(spark, sf, "part").select("p_partkey", both.alias("outline")), "p_partkey", "outline")


@query(
    "f15_final_markdown",
    "SELECT conv_id, '# Topic ' || conv_id::VARCHAR || coalesce(chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), '') AS markdown FROM conversations GROUP BY conv_id",
)
def final(spark, sf):
    return library.final_markdown(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", F.concat(F.lit("# Topic "), F.col("conv_id").cast("string")))


@query("f28_pdf_urls", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'http://b/' || page_id::VARCHAR END AS pdf FROM pages")
def pdf_urls(spark, sf):
    best = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.col("url"))).when(F.col("page_id") % 3 == 1, "ftp://a/b")
    return table(spark, sf, "pages").select("page_id", text.first_url(best, F.concat(F.lit("http://b/"), F.col("page_id").cast("string"))).alias("pdf"))


_CALLS = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'tool' ELSE role END AS role, CASE WHEN role = 'assistant' THEN array('c' || CAST(turn AS STRING), 'd' || CAST(turn AS STRING)) END AS call_ids,
CASE WHEN role = 'user' THEN 'c' || CAST(turn - CASE WHEN turn % 4 = 0 THEN 3 ELSE 1 END AS STRING) END AS call_id, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS content FROM conversations"""


@query(
    "j21_repaired_calls",
    rf"""WITH m AS ({_CALLS.replace("array('c' || CAST(turn AS STRING), 'd' || CAST(turn AS STRING))", "['c' || turn, 'd' || turn]").replace("STRING", "VARCHAR")}), t AS (SELECT DISTINCT conv_id, call_id FROM m WHERE role = 'tool'),
h AS (SELECT a.conv_id, a.turn, a.c FROM (SELECT conv_id, turn, unnest(call_ids) AS c FROM m WHERE role = 'assistant') a JOIN t ON t.conv_id = a.conv_id AND t.call_id = a.c),
g AS (SELECT conv_id, turn, string_agg(c, ',' ORDER BY c) AS kept FROM h GROUP BY 1, 2)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.role = 'assistant' THEN coalesce(g.kept, '') END AS call_ids, m.call_id,
md5(CASE WHEN m.role = 'assistant' AND g.kept IS NULL THEN coalesce(nullif(trim(m.content, ' '), ''), '（这轮的工具调用被中断，未取得结果；如有需要请重新调用对应工具。）') ELSE m.content END) AS content
FROM m LEFT JOIN g ON g.conv_id = m.conv_id AND g.turn = m.turn WHERE m.role <> 'tool' OR EXISTS (SELECT 1 FROM h WHERE h.conv_id = m.conv_id AND h.c = m.call_id AND h.turn < m.turn)""",
)
def call_pairs(spark, sf):
    """An assistant asks for its turn's two calls, users' rows answer the first of one of the calls before, some again."""
    found = library.call_pairs(derived(spark, sf, _CALLS, "conversations"), "conv_id", "turn")
    return found.select("conv_id", "turn", "role", F.array_join("call_ids", ",").alias("call_ids"), "call_id", F.md5("content").alias("content"))
