"""Registered queries of full-text processing, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import identity, text
from quillon.operators import boxes, chunks
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


LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)"


def lines(spark, sf):
    return chunks.lines(table(spark, sf, "documents"))


@query("w04_lines", f"WITH {LINES} SELECT doc_id, pos, length(line) AS n FROM l")
def all_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", F.length("line").alias("n"))


@query("p11_junk_fragments", f"WITH {LINES} SELECT doc_id, pos FROM l WHERE length(trim(regexp_replace(line, '\\s+', ' ', 'g'))) <= 20 AND NOT regexp_matches(line, '\\p{{L}}')")
def junk(spark, sf):
    return lines(spark, sf).where(text.junk_fragment(F.col("line"))).select("doc_id", "pos")


@query(
    "p10_readable",
    "SELECT doc_id, length(trim(text)) >= 3000 AND (length(trim(text)) - length(replace(trim(text), '�', ''))) / greatest(length(trim(text)), 1) <= 0.01 AS readable FROM documents",
)
def readable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.readable(F.col("text")).alias("readable"))


#: Documents as pages of books, with their first and last line and both lines' keys.
PAGED = f"""{LINES}, p AS (SELECT {{book}} AS book, doc_id AS page, min_by(line, pos) AS f, max_by(line, pos) AS t FROM l GROUP BY doc_id),
s AS (SELECT book, page, 'header' AS side, regexp_replace(regexp_replace(f, '[0-9]+', '#', 'g'), '\\s+', '', 'g') AS key FROM p UNION ALL SELECT book, page, 'footer', regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '\\s+', '', 'g') FROM p),
n AS (SELECT book, count(*) AS n FROM p GROUP BY book)"""


def paged(spark, sf, book):
    ends = lines(spark, sf).groupBy("doc_id").agg(F.min_by("line", "pos").alias("f"), F.max_by("line", "pos").alias("t"))
    return ends.select(F.expr(book).alias("book"), F.col("doc_id").alias("page"), "f", "t")


@query(
    "a36_f16_repeated_margins",
    f"""WITH {PAGED.format(book='doc_id // 4')}
SELECT s.book, side, key, count(DISTINCT page) AS pages FROM s JOIN n USING (book) WHERE length(key) BETWEEN 3 AND 160 GROUP BY s.book, side, key, n.n HAVING count(DISTINCT page) >= greatest(2, ceil(n.n / 2))""",
)
def margins(spark, sf):
    return chunks.repeated_margins(paged(spark, sf, "doc_id div 4"), "book", "page", "f", "t")


@query(
    "a37_frequent_margins",
    f"""WITH {PAGED.format(book='doc_id % 40')}
SELECT s.book, key, count(*) AS times FROM s JOIN n USING (book) WHERE length(key) BETWEEN 3 AND 160 AND n.n >= 3 GROUP BY s.book, key HAVING count(*) >= 3""",
)
def frequent_margins(spark, sf):
    return chunks.frequent_margins(paged(spark, sf, "doc_id % 40"), "book", "page", "f", "t")


_BODY = """CASE WHEN pos = 1 AND doc_id % 3 = 0 THEN '## Abstract: we show' WHEN pos = 2 AND doc_id % 5 = 0 THEN 'abstracts are no heading' WHEN pos = 3 THEN CASE doc_id % 4 WHEN 0 THEN '1. Introduction' WHEN 1 THEN 'XL) INTRODUCTION and aims' WHEN 2 THEN '引言' ELSE 'introductions' END
WHEN pos = 9 AND doc_id % 2 = 0 THEN 'iv、 Reference ' WHEN pos = 7 THEN 'References follow' WHEN pos = 8 AND doc_id % 7 = 0 THEN '# 参考文献' ELSE line END"""


@query(
    "w15_f18_body",
    rf"""WITH {LINES}, b AS (SELECT doc_id, pos, {_BODY} AS line FROM l),
k AS (SELECT *, regexp_matches(line, '(?i)^\s*(#{{1,6}}\s*)?((\d+|[ivxlcdm]+)[.)、]?\s*)?(references?|bibliography|参考文献)\s*$') AS is_r, regexp_matches(line, '(?i)^\s*(#{{1,6}}\s*)?(abstract|摘要)([^\p{{L}}\p{{N}}_]|$)') AS is_a,
      regexp_matches(line, '(?i)^\s*(#{{1,6}}\s*)?((\d+|[ivxlcdm]+)[.)、]?\s*)?(introduction|引言)([^\p{{L}}\p{{N}}_]|$)') AS is_i FROM b),
m AS (SELECT *, min(pos) FILTER (WHERE is_r) OVER w AS r, min(pos) FILTER (WHERE is_a) OVER w AS a FROM k WINDOW w AS (PARTITION BY doc_id)),
n AS (SELECT *, min(pos) FILTER (WHERE is_i AND pos > a) OVER (PARTITION BY doc_id) AS i FROM m WHERE r IS NULL OR pos < r)
SELECT doc_id, pos FROM n WHERE NOT coalesce(a < i AND pos BETWEEN a AND i - 1, false)""",
)
def body(spark, sf):
    rows = lines(spark, sf).withColumn("line", F.expr(_BODY))
    return chunks.body(rows, "doc_id", "pos", "line").select("doc_id", "pos")


_FENCE = "CASE WHEN (doc_id + pos) % 5 = 0 THEN '$$' ELSE line END"


@query(
    "w14_fence_state",
    f"WITH {LINES}, b AS (SELECT doc_id, pos, {_FENCE} AS line FROM l) SELECT doc_id, pos, (sum((trim(line) = '$$')::INT) OVER (PARTITION BY doc_id ORDER BY pos)) % 2 = 1 OR trim(line) = '$$' AS in_fence FROM b",
)
def fences(spark, sf):
    return chunks.fence_state(lines(spark, sf).withColumn("line", F.expr(_FENCE)), ["doc_id"], "pos", "line").select("doc_id", "pos", "in_fence")


@query(
    "w17_carried_header",
    f"WITH {LINES}, h AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN substr(line, 1, 10) END AS h FROM l) SELECT doc_id, pos, coalesce(h, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS header FROM h",
)
def header(spark, sf):
    return chunks.carried_header(lines(spark, sf), "doc_id", "pos", F.when(F.col("pos") % 4 == 1, F.substring("line", 1, 10))).select("doc_id", "pos", "header")


@query("w03_j17_neighbours", f"WITH {LINES} SELECT doc_id, pos, lag(doc_id || ':' || pos) OVER w AS previous, lead(doc_id || ':' || pos) OVER w AS next FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def neighbours(spark, sf):
    return chunks.neighbours(lines(spark, sf), "doc_id", "pos", F.concat_ws(":", F.col("doc_id"), F.col("pos"))).select("doc_id", "pos", "previous", "next")


#: Documents as Markdown: a heading, a table and math of a document's own around its text.
MARKDOWN = "concat('# Title ', doc_id, '\\n', coalesce(text, ''), '\\n\\n| a | b |\\n|---|---|\\n', repeat(concat('| ', doc_id, ' | x |\\n'), CAST(doc_id % 7 * 90 AS INT)), '\\n## Part\\n$$\\nx = ', doc_id, '\\n$$\\n| c | d |\\n')"


@query("w13_f17_f20_packed_chunks")
def packed(spark, sf):
    return chunks.packed_blocks(table(spark, sf, "documents").select("doc_id", F.expr(MARKDOWN).alias("text")))


@query("w12_packed_lines")
def packed_lines(spark, sf):
    return chunks.packed(table(spark, sf, "documents"))


@query("w12_batches")
def batches(spark, sf):
    return chunks.batches_within(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text"), 700).select("conv_id", "turn", "batch")


@query(
    "w12_packed_totals",
    f"WITH {LINES}, k AS (SELECT doc_id, sum(length(line)) AS chars, count(*) AS n_lines FROM l WHERE regexp_matches(line, '[^\\s]') GROUP BY doc_id) SELECT doc_id, chars::BIGINT AS chars, n_lines FROM k",
)
def packed_totals(spark, sf):
    p = chunks.packed(table(spark, sf, "documents"))
    return p.groupBy("doc_id").agg(F.sum(F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("chars"), F.sum("n_lines").alias("n_lines"))


KEYWORDS = ["the", "tion", "und", "les", "que"]


@query(
    "t06_top_chunks",
    f"""WITH {LINES}, s AS (SELECT *, {' + '.join(f"contains(lower(line), '{k}')::INT" for k in KEYWORDS)} AS score FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM s WHERE score > 0)
SELECT doc_id, pos, score, place::INT AS place, substr(line, 1, 100) AS line FROM r WHERE place <= 6""",
)
def top_chunks(spark, sf):
    return chunks.top_chunks(lines(spark, sf), "doc_id", "pos", "line", KEYWORDS, 6, 100).select("doc_id", "pos", "score", "place", "line")


@query(
    "t07_contents",
    f"WITH {LINES}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY doc_id) AS total, substr(line, 1, 60) AS preview FROM l) SELECT doc_id, place::INT AS place, total, preview FROM r WHERE place <= 60",
)
def toc(spark, sf):
    return chunks.contents(lines(spark, sf), "doc_id", "pos", "line")


@query(
    "j14_fetched_chunks",
    f"""WITH {LINES}, q AS (SELECT item_id AS request, item_id * 3 AS paper_id, unnest(CASE WHEN item_id % 5 = 0 THEN [] ELSE [0, 1, 4000] [1:(item_id % 3 + 1)::INT] END) AS c, unnest(range(len(CASE WHEN item_id % 5 = 0 THEN [] ELSE [0, 1, 4000] [1:(item_id % 3 + 1)::INT] END))) AS p FROM benchmark),
f AS (SELECT b.item_id AS request, b.item_id * 3 AS paper_id, count(q.c) AS asked, count(l.line) AS n_found, string_agg(substr(l.line, 1, 20), '|' ORDER BY q.p) AS contents FROM benchmark b LEFT JOIN q ON q.request = b.item_id LEFT JOIN l ON l.doc_id = q.paper_id AND l.pos = q.c GROUP BY 1, 2)
SELECT request, paper_id, CASE WHEN asked = 0 THEN 'invalid_arguments' WHEN paper_id NOT IN (SELECT doc_id FROM documents) THEN 'missing_chunks' WHEN n_found < asked THEN 'missing_chunk_ids' ELSE 'ok' END AS status, coalesce(contents, '') AS contents FROM f""",
)
def fetched(spark, sf):
    ids = F.when(F.col("item_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 4000)]), F.lit(1), (F.col("item_id") % 3 + 1).cast("int")))
    requests = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), (F.col("item_id") * 3).alias("paper_id"), ids.alias("ids"))
    known = lines(spark, sf).select(F.col("doc_id").alias("paper_id"), F.col("pos").cast("bigint").alias("chunk_id"), F.substring("line", 1, 20).alias("content"))
    return chunks.fetched(requests, known).select("request", "paper_id", "status", F.array_join("contents", "|").alias("contents"))


@query(
    "j18_nearest",
    """WITH f AS (SELECT l_orderkey AS page, l_linenumber AS fig, l_quantity AS y FROM lineitem), c AS (SELECT l_orderkey AS page, l_linenumber AS cap, l_extendedprice % 60 AS y FROM lineitem),
r AS (SELECT f.page, fig, cap, abs(f.y - c.y) AS d, row_number() OVER (PARTITION BY f.page, fig ORDER BY abs(f.y - c.y), cap) AS n FROM f JOIN c USING (page)) SELECT page, fig, cap, round(d, 6) AS distance FROM r WHERE n = 1""",
)
def nearest(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("fig"), F.col("l_quantity").alias("y"))
    c = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("cap"), (F.col("l_extendedprice") % 60).alias("cy"))
    return chunks.nearest(f, c, ["page"], "fig", "y", "cap", "cy").select("page", "fig", "cap", F.round("distance", 6).alias("distance"))


_BOX = "SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS x0, l_quantity + 4 AS x1, l_extendedprice % 40 AS y0, l_extendedprice % 40 + 6 AS y1 FROM lineitem"


@query(
    "a44_a40_components",
    f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM ({_BOX})),
e AS MATERIALIZED (SELECT p.i AS a, q.i AS c FROM b p JOIN b q ON p.page = q.page AND p.x0 <= q.x1 + 2 AND q.x0 <= p.x1 + 2 AND p.y0 <= q.y1 + 2 AND q.y0 <= p.y1 + 2 AND p.i <> q.i),
r AS (SELECT i AS node, i AS root FROM b UNION SELECT e.c, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT b.page, min(box)::BIGINT AS grp, count(*) AS n, round(min(x0)::DOUBLE, 6) AS x0, round(max(y1)::DOUBLE, 6) AS y1 FROM b JOIN m ON m.node = b.i GROUP BY b.page, m.root""",
)
def components(spark, sf):
    each = derived(spark, sf, _BOX, "lineitem").selectExpr("page", "CAST(box AS BIGINT) AS box", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("x0", "x1", "y0", "y1")])
    return boxes.components(each, ["page"], 2.0).select("page", F.col("group").alias("grp"), "n", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query("f12_safe_names", rf"WITH p AS ({PAPERS}) SELECT id, coalesce(nullif(substr(regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}}._-]', '_', 'g'), 1, 160), ''), 'paper') AS name FROM p")
def names(spark, sf):
    return derived(spark, sf, PAPERS, "documents").select("id", text.safe_name(F.col("title")).alias("name"))


@query("f36_digests", "SELECT doc_id, substr(sha1(text), 1, 12) AS cache_key, sha256(text) AS digest FROM documents")
def digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha1("text"), 1, 12).alias("cache_key"), F.sha2("text", 256).alias("digest"))


@query("f38_t12_head_and_tail", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 200) || ' … ' || right(text, 100) ELSE text END AS text FROM documents")
def head_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.head_and_tail(F.col("text"), 300, " … ").alias("text"))


@query(
    "f14_k06_bibtex",
    f"""WITH p AS ({PAPERS}) SELECT id, '@' || CASE WHEN source <> '' THEN 'article' ELSE 'misc' END || '{{' || id || ',' || chr(10) || CASE WHEN title <> '' THEN '  title = {{' || title || '}},' || chr(10) ELSE '' END
|| '  author = {{A. One and B. Two}},' || chr(10) || CASE WHEN year IS NOT NULL THEN '  year = {{' || year || '}},' || chr(10) ELSE '' END || '  journal = {{' || source || '}},' || chr(10) || '}}' AS bib FROM p""",
)
def bib(spark, sf):
    p = derived(spark, sf, PAPERS, "documents")
    return p.select("id", text.bibtex(F.col("id"), F.col("title"), F.array(F.lit("A. One"), F.lit("B. Two")), F.col("year"), F.col("source"), F.lit("")).alias("bib"))


_CITING = """SELECT id, title, source, year, doi, CASE ord % 4 WHEN 0 THEN 'Li, A|Wu|C|D' WHEN 1 THEN '张三|李四|王五|赵六' WHEN 2 THEN 'One| ' ELSE '' END AS names, CASE WHEN ord % 3 > 0 THEN ord % 30 END AS volume, CASE WHEN ord % 5 > 1 THEN ord % 6 END AS issue,
CASE WHEN ord % 2 = 0 THEN '1-' || CAST(ord AS STRING) END AS pages, CASE ord % 7 WHEN 0 THEN 'conference paper' WHEN 1 THEN 'PhD Thesis' WHEN 2 THEN 'Book' WHEN 3 THEN source ELSE NULL END AS kind, CASE WHEN ord % 3 = 1 THEN 'http://x/' || id END AS url FROM p"""


@query(
    "f13_references",
    f"""WITH p AS ({PAPERS}), c AS ({_CITING.replace("STRING", "VARCHAR")}), n AS (SELECT *, list_filter(list_transform(string_split(names, '|'), lambda a: trim(a)), lambda a: a <> '') AS a FROM c)
SELECT id, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || CASE WHEN a[1] = '张三' THEN '，等' ELSE ', et al' END || '. ' WHEN len(a) > 0 THEN array_to_string(a, ', ') || '. ' ELSE '' END || trim(title) || '['
|| CASE WHEN kind LIKE 'conf%' THEN 'C' WHEN kind LIKE '%Thesis' THEN 'D' WHEN kind = 'Book' THEN 'M' WHEN kind = 'arxiv' THEN 'EB/OL' ELSE 'J' END || ']. ' || source || coalesce(', ' || year, '')
|| CASE WHEN volume IS NOT NULL THEN ', ' || volume || coalesce('(' || issue || ')', '') ELSE coalesce(', (' || issue || ')', '') END || coalesce(': ' || pages, '') || '.'
|| CASE WHEN coalesce(doi, '') <> '' THEN ' DOI: ' || doi || '.' ELSE coalesce(' ' || url || '.', '') END AS ref FROM n""",
)
def references(spark, sf):
    p = spark.sql(_CITING.replace("FROM p", "FROM {p}"), p=derived(spark, sf, PAPERS, "documents"))
    ref = text.gbt_reference(F.split("names", "[|]", -1), F.col("title"), F.col("source"), F.col("year"), F.col("doi"), F.col("volume"), F.col("issue"), F.col("pages"), F.col("kind"), F.col("url"))
    return p.select("id", ref.alias("ref"))


_CITED = "coalesce(text, '') || ' [p' || CAST(doc_id % 50 AS STRING) || '] and [10.1000/x' || CAST(doc_id % 9 AS STRING) || '] [12] [todo] [link](http) [p' || CAST(doc_id % 50 AS STRING) || ']'"


@query(
    "f07_j07_bracket_citations",
    f"""WITH t AS (SELECT doc_id, regexp_replace({_CITED.replace('STRING', 'VARCHAR')}, '\\[[^\\[\\]]+\\]\\(', '(', 'g') AS x FROM documents),
c AS (SELECT doc_id, trim(unnest(regexp_extract_all(x, '\\[([^\\[\\]]+)\\]', 1))) AS cited FROM t)
SELECT DISTINCT doc_id, cited FROM c WHERE regexp_matches(cited, '^[A-Za-z0-9][A-Za-z0-9_.:/()-]+$') AND NOT regexp_matches(cited, '^\\d+$') AND lower(cited) NOT IN ('todo', 'note', 'fixme')""",
)
def citations(spark, sf):
    """Over the whole text of every document, its own brackets and those that the query glues on."""
    return table(spark, sf, "documents").select("doc_id", F.explode(text.bracket_citations(F.expr(_CITED))).alias("cited"))


@query("f27_inverted_index", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM documents")
def inverted(spark, sf):
    index = table(spark, sf, "documents").select("doc_id", text.inverted_index(F.split(F.when(F.col("text").isNotNull(), text.collapsed(F.col("text"))), " ")).alias("m"))
    return index.select("doc_id", text.from_inverted_index(F.col("m")).alias("abstract"))


@query("f33_lenient_json", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def lenient(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", text.lenient_json(raw, "k int")["k"].alias("k"))


@query("f42_coercers", f"WITH p AS ({PAPERS}) SELECT id, CASE WHEN year > 2000 THEN year END AS year, least(100, greatest(0, coalesce(cited_by, 0))) AS score FROM p")
def coercers(spark, sf):
    p = derived(spark, sf, PAPERS, "documents")
    raw = F.when(F.col("year") > 2000, F.col("year").cast("string")).when(F.col("year") % 2 == 0, F.lit("-3")).when(F.col("year") % 3 == 0, F.lit("")).otherwise(F.lit("n.d."))
    return p.select("id", identity.year(raw).alias("year"), F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("cited_by", F.lit(0)))).alias("score"))


@query("p16_urls", "SELECT page_id, regexp_matches(url, '^https?://') AS is_http, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.col("url").rlike("^https?://").alias("is_http"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("s13_html_blocks")
def html(spark, sf):
    return payloads.html_blocks(table(spark, sf, "pages"))


@query("s02_work_payloads", "SELECT doc_id AS rank_of, 'W' || doc_id::VARCHAR AS id, '10.1000/x' || (doc_id % 9)::VARCHAR AS doi, (1990 + doc_id % 30)::INT AS year FROM documents")
def work_payloads(spark, sf):
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.1000/X"), (F.col("doc_id") % 9).cast("string")).alias("doi"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (1990 + F.col("doc_id") % 30).cast("int").alias("publication_year"))).alias("results")))
    found = payloads.works(table(spark, sf, "documents").select(body.alias("payload")))
    return found.select(F.substring("id", 2, 20).cast("long").alias("rank_of"), "id", "doi", "year")


@query("s04_title_payloads", "SELECT doc_id, 'P' || doc_id::VARCHAR AS paper_id, (1990 + doc_id % 30)::INT AS year FROM documents")
def title_payloads(spark, sf):
    one = F.to_json(F.struct(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("paperId"), (1990 + F.col("doc_id") % 30).alias("year")))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"data":['), one, F.lit("]}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"data":'), one, F.lit("}"))).otherwise(one)
    return payloads.title_matches(table(spark, sf, "documents").select("doc_id", body.alias("payload"))).select("doc_id", "paper_id", "year")


@query("s01_feed_payloads", "SELECT 'http://a/' || doc_id::VARCHAR AS id, 'Title ' || (doc_id % 7)::VARCHAR AS title, (2000 + doc_id % 20)::INT AS year FROM documents WHERE doc_id % 7 > 0")
def feed(spark, sf):
    d = table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("Title  "), (F.col("doc_id") % 7).cast("string"))).otherwise(F.lit(" "))
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://a/'), F.col("doc_id").cast("string"), F.lit("</id><title>"), title, F.lit("</title><published>"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("-01-01</published></entry></feed>"))
    return payloads.feed_entries(d.select(entry.alias("payload"))).select("id", "title", "year")


@query("s14_jsonl_events", "SELECT event_id, event_type FROM events WHERE event_id % 5 > 1")
def jsonl(spark, sf):
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, F.when(F.col("event_id") % 2 == 0, "[1]").otherwise('{"event_id": ')).otherwise(good)
    return payloads.jsonl_events(table(spark, sf, "events").select(line.alias("line")), "event_id bigint, event_type string")


@query("k08_s19_sse_round_trip", "SELECT event_id::VARCHAR AS id, event_type AS event, props AS data FROM events")
def sse(spark, sf):
    e = payloads.encoded_events(table(spark, sf, "events"), "event_id", "event_type", F.col("props"))
    return payloads.decoded_events(e)


@query("s23_front_matter", "SELECT doc_id, doc_id % 12 AS version FROM documents")
def front(spark, sf):
    body = F.concat(F.lit('---\n{"version": '), (F.col("doc_id") % 12).cast("string"), F.lit("}\n---\n"), F.col("text"))
    return payloads.front_matter(table(spark, sf, "documents").select("doc_id", body.alias("text")), "version bigint")


@query(
    "j19_box_overlap",
    f"WITH b AS ({_BOX}) SELECT a.page, a.box AS a, c.box AS b FROM b a JOIN b c ON a.page = c.page AND a.box < c.box WHERE greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) >= 0.5 * 24",
)
def overlap(spark, sf):
    return chunks.overlapping(derived(spark, sf, _BOX, "lineitem"), ["page"], "box", 12)


@query("u03_u04_u05_sets", "SELECT doc_id, len(list_intersect(a, b)) > 0 AS meets, list_sort(list_distinct(list_concat(a, b)))::VARCHAR AS joined, list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)))::VARCHAR AS only_a FROM (SELECT doc_id, [doc_id % 3, doc_id % 5] AS a, [doc_id % 4, doc_id % 7] AS b FROM documents)")
def sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array(F.col("doc_id") % 3, F.col("doc_id") % 5).alias("a"), F.array(F.col("doc_id") % 4, F.col("doc_id") % 7).alias("b"))
    joined = F.array_sort(F.array_distinct(F.concat("a", "b"))).cast("string")
    return d.select("doc_id", F.arrays_overlap("a", "b").alias("meets"), joined.alias("joined"), F.array_sort(F.array_except("a", "b")).cast("string").alias("only_a"))


_SIGNS = "concat(text, CASE doc_id % 3 WHEN 0 THEN ' 𝑆𝛼 = Σ + * / |_ ∑∈ x₂ → ℓ' ELSE ' ± − a' END)"


@query(
    "f32_math_share",
    rf"""WITH v AS (SELECT doc_id, regexp_replace({_SIGNS}, '[\s\p{{Z}}]', '', 'g') AS v, regexp_replace({_SIGNS.replace("text", "''")}, '[\s\p{{Z}}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, '[\x{{370}}-\x{{3FF}}\x{{2070}}-\x{{209F}}\x{{2100}}-\x{{214F}}\x{{2190}}-\x{{22FF}}\x{{27C0}}-\x{{27EF}}\x{{2980}}-\x{{2AFF}}\x{{1D400}}-\x{{1D7FF}}±·×÷∓∗∘√∞∂∇‖−′″]' AS signs FROM v)
SELECT doc_id, round((length(v) - length(regexp_replace(v, signs, '', 'g'))) / length(v), 9) AS share, length(t) >= 2 AND (length(t) - length(regexp_replace(t, signs, '', 'g'))) / length(t) >= 0.5 AS is_math FROM m""",
)
def math(spark, sf):
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    tail = F.expr(_SIGNS.replace("text", "''"))
    return d.select("doc_id", F.round(text.math_share(F.expr(_SIGNS)), 9).alias("share"), text.is_math_line(tail).alias("is_math"))
