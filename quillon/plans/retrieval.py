"""Registered queries of search, identity and ranking quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import identity, text
from quillon.operators import metrics, retrieval
from quillon.operators.ranks import percentiles
from quillon.shared import shared_folder
from quillon.sources import plugins
from quillon.sources.tables import CASES, JUDGED, PAPERS, derived, table

GROUPS = [["the", "der", "les"], ["on", "und", "de"], ["thing", "chts", "ment"]]
EXCLUDED = ["###", "!!"]


def papers(spark, sf):
    return identity.with_keys(derived(spark, sf, PAPERS, "documents"), ["id", "arxiv_id"], fallback=F.concat(F.lit("row:"), F.col("id")))


def _hay(alias=""):
    return f"lower(coalesce({alias}title,'') || ' ' || coalesce({alias}abstract,''))"


def _any(terms):
    return "(" + " OR ".join(f"contains({_hay()}, '{t}')" for t in terms) + ")"


#: The key expressions in DuckDB's dialect, on top of PAPERS.
KEYED = f"""
p0 AS ({PAPERS}),
p1 AS (SELECT *, lower(regexp_replace(regexp_replace(trim(coalesce(doi, '')), '^https?://doi\\.org/', ''), '^https?://dx\\.doi\\.org/', '')) AS d,
       regexp_replace(trim(coalesce(arxiv_id, '')), 'v\\d+$', '') AS a,
       trim(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''), ' ' || chr(10) || chr(9) || chr(13))), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM p0),
papers AS (SELECT *, CASE WHEN d LIKE '10.48550/arxiv.%' THEN 'arxiv:' || regexp_replace(substr(d, 16), 'v\\d+$', '')
       WHEN d <> '' THEN 'doi:' || d WHEN a <> '' THEN 'arxiv:' || a WHEN t <> '' THEN 'title:' || t ELSE 'row:' || id END AS key FROM p1)
"""

Q, O = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("f01_doi_f02_preprint_f03_title_f04_key", f"WITH {KEYED} SELECT id, d AS doi_norm, a AS preprint, CASE WHEN t = '' THEN '' ELSE 'title:' || t END AS title_key, key FROM papers")
def keys(spark, sf):
    return papers(spark, sf).select("id", "doi_norm", identity.without_version(F.col("arxiv_id")).alias("preprint"), "title_key", "key")


@query(
    "a01_a03_u02_merge_duplicates",
    f"""WITH {KEYED},
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(cited_by, 0) DESC, ord) AS n FROM papers),
g AS (SELECT key, list_sort(list(DISTINCT source)) AS sources, min(ord) AS first_ord, min_by(arxiv_id, ord) FILTER (WHERE coalesce(arxiv_id, '') <> '') AS fa,
      min_by(pdf_url, ord) FILTER (WHERE pdf_url <> '') AS fp FROM papers GROUP BY key)
SELECT g.key, array_to_string(g.sources, ',') AS sources, g.first_ord, r.id, r.cited_by, r.year, coalesce(g.fa, '') AS arxiv_id,
       CASE WHEN r.pdf_url <> '' THEN r.pdf_url ELSE coalesce(g.fp, '') END AS pdf_url
FROM g JOIN r ON r.key = g.key AND r.n = 1""",
)
def merge(spark, sf):
    m = retrieval.merged_duplicates(papers(spark, sf))
    return m.select("key", F.array_join("sources", ",").alias("sources"), "first_ord", "id", "cited_by", "year", "arxiv_id", "pdf_url")


@query(
    "a02_w01_rank_fusion",
    f"""WITH {KEYED}, r AS (SELECT key, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM papers)
SELECT key, round(sum(1.0::DOUBLE / (60 + n)), 10) AS rrf FROM r GROUP BY key""",
)
def fusion(spark, sf):
    return retrieval.fused_ranks(papers(spark, sf)).select("key", F.round("rrf", 10).alias("rrf"))


_FIT = f"(year IS NULL OR year BETWEEN 1995 AND 2020) AND NOT {_any(EXCLUDED)} AND " + " AND ".join(_any(g) for g in GROUPS)


@query("p03_p04_p06_filters", f"WITH p AS ({PAPERS}) SELECT id, year FROM p WHERE {_FIT}")
def filters(spark, sf):
    p = derived(spark, sf, PAPERS, "documents")
    t, a = F.col("title"), F.col("abstract")
    return p.where(retrieval.within_years(F.col("year"), 1995, 2020) & retrieval.excludes(t, a, EXCLUDED) & retrieval.matches(t, a, GROUPS)).select("id", "year")


@query("p07_concept_hits", f"WITH p AS ({PAPERS}) SELECT id, {' + '.join(f'CAST({_any(g)} AS INT)' for g in GROUPS)} AS hits FROM p")
def hits(spark, sf):
    return derived(spark, sf, PAPERS, "documents").select("id", retrieval.concept_hits(F.col("title"), F.col("abstract"), GROUPS).alias("hits"))


@query(
    "t01_t02_u01_federated_search",
    f"""WITH {KEYED}, fit AS (SELECT * FROM papers WHERE {_FIT}),
rf AS (SELECT key, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM fit),
f AS (SELECT key, sum(1.0::DOUBLE / (60 + n)) AS rrf FROM rf GROUP BY key),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY coalesce(cited_by, 0) DESC, ord) AS n FROM fit),
g AS (SELECT key, count(DISTINCT source) AS n_sources, min(ord) AS first_ord FROM fit GROUP BY key)
SELECT b.id, b.key, g.n_sources::INT AS n_sources, round(f.rrf, 10) AS rrf FROM b JOIN g ON b.key = g.key JOIN f ON f.key = b.key WHERE b.n = 1
ORDER BY f.rrf DESC, g.n_sources DESC, {' + '.join(f'CAST({_any(x)} AS INT)' for x in GROUPS)} DESC, coalesce(b.cited_by, 0) DESC, coalesce(b.year, 0) DESC, g.first_ord LIMIT 20""",
)
def search(spark, sf):
    p = papers(spark, sf)
    sources = {s: p.where(F.col("source") == s) for s in ("arxiv", "openalex", "semantic_scholar")}
    both = retrieval.federated(sources, ["arxiv", "missing", "openalex", "semantic_scholar"])
    found = retrieval.search(both, GROUPS, 20, 1995, 2020, EXCLUDED)
    return found.select("id", "key", F.col("n_sources").cast("int").alias("n_sources"), F.round("rrf", 10).alias("rrf"))


def _relaxed_sql(need):
    sets = [GROUPS[: 3 - d] for d in range(3)]
    cond = [" AND ".join(_any(g) for g in s) for s in sets]
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS c{i}" for i, c in enumerate(cond))
    return f"""WITH p AS ({PAPERS}), c AS (SELECT {counts} FROM p), d AS (SELECT CASE WHEN c0 >= {need} THEN 0 WHEN c1 >= {need} THEN 1 ELSE 2 END AS dropped FROM c)
SELECT p.id, d.dropped FROM p, d WHERE CASE d.dropped WHEN 0 THEN {cond[0]} WHEN 1 THEN {cond[1]} ELSE {cond[2]} END"""


@query("t10_relaxation", _relaxed_sql(100_000))
def relaxation(spark, sf):
    return retrieval.relaxed_search(derived(spark, sf, PAPERS, "documents"), GROUPS, 100_000).select("id", "dropped")


@query(
    "a05_duplicate_violations",
    f"""WITH {KEYED}, e AS (SELECT 'doi' AS kind, d AS value, id, ord FROM papers UNION ALL SELECT 'arxiv', a, id, ord FROM papers
UNION ALL SELECT 'title', CASE WHEN t = '' THEN '' ELSE 'title:' || t END, id, ord FROM papers)
SELECT kind, value, string_agg(id, ',' ORDER BY ord) AS ids FROM e WHERE value <> '' GROUP BY kind, value HAVING count(*) > 1""",
)
def violations(spark, sf):
    return retrieval.duplicate_violations(derived(spark, sf, PAPERS, "documents")).select("kind", "value", F.array_join("ids", ",").alias("ids"))


@query(
    "j02_j05_citation_resolution",
    f"""WITH {KEYED}, s AS (SELECT key, ord, unnest(list_distinct([d, 'arxiv:' || a, 'p' || ord::VARCHAR])) AS name FROM papers),
k AS (SELECT name, min_by(key, ord) AS key FROM s WHERE name NOT IN ('', 'arxiv:') GROUP BY name),
q AS (SELECT DISTINCT 'https://doi.org/10.1000/x' || (item_id % 120)::VARCHAR AS ref, '10.1000/x' || (item_id % 120)::VARCHAR AS d FROM benchmark)
SELECT q.ref, k.key FROM q LEFT JOIN k ON k.name = q.d""",
)
def resolution(spark, sf):
    wanted = table(spark, sf, "benchmark").select(F.concat(F.lit("https://doi.org/10.1000/x"), (F.col("item_id") % 120).cast("string")).alias("ref"))
    return retrieval.resolved_aliases(papers(spark, sf), wanted)


_EDGES = "SELECT doc_id AS src, (doc_id * 31 + 7) % (SELECT count(*) FROM documents) AS dst FROM documents UNION SELECT doc_id, (doc_id * 17 + 3) % (SELECT count(*) FROM documents) FROM documents"


@query(
    "j23_citation_expansion",
    f"""WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT doc_id AS node FROM documents WHERE doc_id % 50 = 0),
w AS (SELECT node AS seed, node, 0 AS hop FROM s UNION SELECT w.seed, e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 2)
SELECT seed, node, min(hop) AS hop FROM w GROUP BY seed, node HAVING min(hop) > 0""",
)
def expansion(spark, sf):
    d = table(spark, sf, "documents")
    n = d.agg(F.count("*").alias("n"))
    base = d.select("doc_id").join(F.broadcast(n))  # one row
    edges = base.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 31 + 7) % F.col("n")).alias("dst")).union(base.select("doc_id", ((F.col("doc_id") * 17 + 3) % F.col("n")))).distinct()
    seeds = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("node"))
    return retrieval.expanded(seeds, edges, 2)


@query(
    "a07_a08_a09_ranking_quality",
    f"""WITH j AS ({JUDGED}), n AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, rn) AS best FROM n WHERE rn <= 10),
a AS (SELECT case_id, sum(score / log2(rn + 1)) AS dcg, sum(score / log2(best + 1)) AS idcg, avg((score >= 2)::INT) AS p FROM t GROUP BY case_id),
h AS (SELECT case_id, count(*) AS n, coalesce(avg(score) FILTER (WHERE rn <= floor(n / 2)) - avg(score) FILTER (WHERE rn > floor(n / 2)), 0) AS gap, min(score) = max(score) AS saturated FROM n GROUP BY case_id)
SELECT a.case_id, h.n, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 9) AS ndcg, round(p, 9) AS precision, round(gap, 9) AS gap, saturated FROM a JOIN h USING (case_id)""",
)
def quality(spark, sf):
    q = metrics.ranking_quality(derived(spark, sf, JUDGED, "embeddings"))
    return q.select("case_id", "n", *[F.round(c, 9).alias(c) for c in ("ndcg", "precision", "gap")], "saturated")


@query(
    "a12_a13_suite",
    f"""WITH c AS ({CASES}) SELECT count(*) AS cases, count(*) FILTER (WHERE status = 'ok') AS ok_cases,
count(*) FILTER (WHERE status = 'ok' AND judge_status = 'ok' AND saturated) AS saturated_cases,
round(avg(ndcg) FILTER (WHERE status = 'ok' AND judge_status = 'ok' AND NOT saturated), 6) AS ndcg, round(avg(precision) FILTER (WHERE status = 'ok' AND judge_status = 'ok' AND NOT saturated), 6) AS precision,
round(avg(gap) FILTER (WHERE status = 'ok' AND judge_status = 'ok' AND NOT saturated), 6) AS gap, round(avg(recall) FILTER (WHERE status = 'ok' AND judge_status = 'ok'), 6) AS recall,
round(quantile_cont(latency, 0.5) FILTER (WHERE status = 'ok'), 4) AS latency_p50, round(quantile_cont(latency, 0.95) FILTER (WHERE status = 'ok'), 4) AS latency_p95 FROM c""",
)
def suite(spark, sf):
    s = metrics.suite(derived(spark, sf, CASES, "orders"))
    return s.select("cases", "ok_cases", "saturated_cases", *[F.round(c, 6).alias(c) for c in ("ndcg", "precision", "gap", "recall")], *[F.round(c, 4).alias(c) for c in ("latency_p50", "latency_p95")])


@query(
    "a14_percentile_nearest",
    "SELECT event_type, list_sort(list(value))[least(floor(count(value) * 95 / 100)::INT, count(value)::INT - 1) + 1] AS p95 FROM events GROUP BY event_type",
)
def nearest(spark, sf):
    return percentiles(table(spark, sf, "events"), ["event_type"], {"p95": ("value", 0.95, "nearest")})


_METRICS = """SELECT CASE p_partkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS layer, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 10 END AS value,
CAST(p_partkey % 7 + 1 AS DOUBLE) AS target, CASE p_partkey % 4 WHEN 0 THEN 'higher' WHEN 1 THEN 'lower' WHEN 2 THEN 'judge' ELSE 'violation' END AS direction FROM part"""
_POINTS = """CASE WHEN value IS NULL THEN NULL WHEN direction = 'higher' THEN 100 * least(value / target, 1.0) WHEN direction = 'lower' THEN 100 * least(target / greatest(value, 1e-9), 1.0)
WHEN direction = 'judge' THEN 100 * value / 5 ELSE CASE WHEN value > 0 THEN 0.0 ELSE 100.0 END END"""


@query("a24_a25_layer_scores", f"WITH m AS ({_METRICS}), s AS (SELECT layer, {_POINTS} AS p FROM m) SELECT layer, round(avg(p), 6) AS score, count(p) AS scored, count(*) - count(p) AS missing FROM s GROUP BY layer")
def layers(spark, sf):
    s = metrics.layer_scores(derived(spark, sf, _METRICS, "part"))
    return s.select("layer", F.round("score", 6).alias("score"), "scored", "missing")


@query(
    "a26_overall",
    f"WITH m AS ({_METRICS}), s AS (SELECT layer, avg({_POINTS}) AS score FROM m GROUP BY layer) SELECT round(sum(w * score) / sum(w), 6) AS overall FROM (SELECT score, CASE layer WHEN 'L1' THEN 0.3 WHEN 'L2' THEN 0.5 ELSE 0.2 END::DOUBLE AS w FROM s WHERE score IS NOT NULL)",
)
def overall(spark, sf):
    return metrics.overall(metrics.layer_scores(derived(spark, sf, _METRICS, "part"))).select(F.round("overall", 6).alias("overall"))


@query(
    "a27_w21_trend",
    """SELECT o_custkey AS suite, o_orderkey AS run, CASE WHEN lag(o_totalprice) OVER w IS NULL THEN NULL WHEN abs(o_totalprice - lag(o_totalprice) OVER w) < 5000 THEN 'flat'
WHEN o_totalprice > lag(o_totalprice) OVER w THEN 'up' ELSE 'down' END AS trend FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def trend(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("suite"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("score"))
    return metrics.trend(runs, "run", "score", 5000).select("suite", "run", "trend")


@query(
    "a30_judge_agreement",
    """WITH p AS (SELECT label AS human, (label + vec_id % 3) % 10 AS judge FROM embeddings),
h AS (SELECT human, judge, rank() OVER (ORDER BY human) + (count(*) OVER (PARTITION BY human) - 1) / 2.0 AS rh, rank() OVER (ORDER BY judge) + (count(*) OVER (PARTITION BY judge) - 1) / 2.0 AS rj FROM p)
SELECT count(*) AS n, round(avg((abs(human - judge) <= 1)::INT), 6) AS within_one, round(avg((human = judge)::INT), 6) AS exact, round(corr(rh, rj), 6) AS spearman FROM h""",
)
def agreement(spark, sf):
    pairs = table(spark, sf, "embeddings").select(F.col("label").alias("human"), ((F.col("label") + F.col("vec_id") % 3) % 10).alias("judge"))
    return metrics.agreement(pairs).select("n", *[F.round(c, 6).alias(c) for c in ("within_one", "exact", "spearman")])


@query("a30_confusion", "SELECT label AS human, ((label + vec_id % 3) % 10) AS judge, count(*) AS n FROM embeddings GROUP BY 1, 2")
def confusion(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("human"), ((F.col("label") + F.col("vec_id") % 3) % 10).alias("judge")).agg(F.count("*").alias("n"))


_LEVEL = "CASE (p_partkey + {k}) % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'partial_match' WHEN 2 THEN 'not_match' ELSE 'other' END"


@query(
    "a43_match_score",
    "SELECT p_partkey, floor("
    + " + ".join(f"CASE {_LEVEL.format(k=k)} WHEN 'match' THEN {float(w)} WHEN 'partial_match' THEN {w / 2} ELSE 0.0 END" for k, w in ((0, 50), (1, 30), (2, 20)))
    + " + 0.5)::INT AS score FROM part",
)
def match_score(spark, sf):
    levels = {n: F.expr(_LEVEL.format(k=k)) for k, n in enumerate(("topic", "method", "setting"))}
    return table(spark, sf, "part").select("p_partkey", metrics.match_score(levels).alias("score"))


@query(
    "a32_completeness_score",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 THEN least(5.0, greatest(1.0, floor((1 + 4 * (l_linenumber + 0.5 * (l_suppkey % 3)) / l_quantity) * 2 + 0.5) / 2)) END AS score FROM lineitem",
)
def completeness_score(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", metrics.completeness_score(F.col("l_linenumber"), F.col("l_suppkey") % 3, F.col("l_quantity")).alias("score"))


@query(
    "a06_field_completeness",
    f"WITH p AS ({PAPERS}) SELECT round(avg((coalesce(title, '') <> '')::INT), 9) AS title, round(avg((year IS NOT NULL)::INT), 9) AS year, round(avg((coalesce(abstract, '') <> '')::INT), 9) AS abstract, round(avg((coalesce(doi, '') <> '' OR coalesce(id, '') <> '')::INT), 9) AS id FROM p",
)
def completeness(spark, sf):
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    c = metrics.completeness(derived(spark, sf, PAPERS, "documents"), {"title": filled("title"), "year": F.col("year").isNotNull(), "abstract": filled("abstract"), "id": filled("doi") | filled("id")})
    return c.select(*[F.round(x, 9).alias(x) for x in c.columns])


@query(
    "j10_a11_golden_recall",
    f"""WITH {KEYED}, r AS (SELECT ord % 50 AS case_id, row_number() OVER (PARTITION BY ord % 50 ORDER BY ord) AS place, d, a, t FROM papers),
g AS (SELECT b.item_id, b.item_id % 50 AS case_id, CASE WHEN b.item_id % 3 = 0 THEN p.d ELSE '' END AS d, CASE WHEN b.item_id % 3 = 1 THEN '2401.' || lpad((b.item_id % 120)::VARCHAR, 5, '0') ELSE '' END AS a,
      CASE WHEN b.item_id % 3 = 2 THEN substr(p.t, 1, 9 + b.item_id::INT % 40) ELSE '' END AS t FROM benchmark b LEFT JOIN papers p ON p.ord = b.item_id),
h AS (SELECT g.case_id, g.item_id, coalesce(bool_or((g.d <> '' AND g.d = r.d) OR (g.a <> '' AND g.a = r.a) OR (g.t <> '' AND r.t <> '' AND (contains(g.t, r.t) OR contains(r.t, g.t)))), false) AS hit FROM g LEFT JOIN r ON r.case_id = g.case_id AND r.place <= 20 GROUP BY 1, 2)
SELECT case_id, round(avg(hit::INT), 9) AS recall, count(*) AS golden FROM h GROUP BY 1""",
)
def golden(spark, sf):
    bare = F.regexp_replace("title_key", "^title:", "")
    p = papers(spark, sf).select("ord", F.col("doi_norm").alias("doi"), identity.without_version(F.col("arxiv_id")).alias("arxiv"), bare.alias("title"))
    results = p.withColumn("case_id", F.col("ord") % 50).withColumn("place", F.row_number().over(W.partitionBy("case_id").orderBy("ord")))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("gid")).join(p.withColumnRenamed("ord", "gid"), "gid", "left")
    i = F.col("gid")
    g = b.select(
        "gid", (i % 50).alias("case_id"),
        F.when(i % 3 == 0, F.coalesce("doi", F.lit(""))).otherwise("").alias("doi"),
        F.when(i % 3 == 1, F.concat(F.lit("2401."), F.lpad((i % 120).cast("string"), 5, "0"))).otherwise("").alias("arxiv"),
        F.when(i % 3 == 2, F.coalesce(F.substring(F.col("title"), F.lit(1), (9 + i % 40).cast("int")), F.lit(""))).otherwise("").alias("title"),
    )
    return metrics.golden_recall(results, g).select("case_id", F.round("recall", 9).alias("recall"), "golden")


@query("a10_multi_source_rate", f"WITH {KEYED}, g AS (SELECT key, count(DISTINCT source) AS n FROM papers GROUP BY key) SELECT round(avg((n >= 2)::INT), 9) AS rate FROM g")
def multi_source(spark, sf):
    return retrieval.merged_duplicates(papers(spark, sf)).agg(F.round(F.avg((F.size("sources") >= 2).cast("int")), 9).alias("rate"))


@query(
    "p01_p02_cards",
    f"WITH p AS ({PAPERS}) SELECT id, CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '…' ELSE title END AS title, CASE WHEN length(abstract) > 100 THEN substr(abstract, 1, 100) || '…' ELSE abstract END AS abstract, coalesce(doi, id) AS paper_id FROM p",
)
def cards(spark, sf):
    p = derived(spark, sf, PAPERS, "documents")
    return p.select("id", text.clipped(F.col("title"), 20, "…").alias("title"), text.clipped(F.col("abstract"), 100, "…").alias("abstract"), F.coalesce("doi", "id").alias("paper_id"))


def recorded(spark, sf):
    """Every paper as its provider's recorded responses, read again through the data source."""
    import uuid

    root = f"{shared_folder(spark)}/quillon-pages-{uuid.uuid4().hex}"
    plugins.record_pages(papers(spark, sf), root)
    plugins.register(spark)
    return spark.read.format("recorded_search").option("root", root).load()


@query(
    "d02_s01_s02_s03_s21_recorded_search",
    f"""WITH p AS ({PAPERS}) SELECT source AS provider, (ord // 300)::INT AS page, id, regexp_replace(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '^$', '') AS title, year,
CASE WHEN source <> 'arxiv' THEN doi END AS doi, CASE source WHEN 'arxiv' THEN id WHEN 'semantic_scholar' THEN arxiv_id END AS arxiv_id, CASE WHEN source <> 'arxiv' THEN cited_by END AS cited_by
FROM p WHERE year BETWEEN 2000 AND 2010 AND coalesce(trim(title), '') <> ''""",
)
def recorded_search(spark, sf):
    found = recorded(spark, sf).where("year >= 2000 AND year <= 2010")
    title = text.collapsed(F.col("title"))
    return found.select("provider", "page", "id", title.alias("title"), "year", "doi", "arxiv_id", "cited_by")
