"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact, importance, lines, mixing, near, neighbours, quality_model, quality_rules, secrets, sharding, substrings, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents")).drop("tkey")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), (5, 2, 1), 1.0, 3.0).drop("copies")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


SQL_OP1 = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                 ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x
  FROM d),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.k + nb.k - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.k
"""

SQL_OP4 = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, (len(x) // 2) - 49)) AS p, x FROM d WHERE len(x) >= 100),
h AS (SELECT doc_id, p, md5(substr(x, (2 * p + 1)::BIGINT, 100)) AS k FROM w),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT h.doc_id, h.p FROM h JOIN f ON h.k = f.k WHERE h.doc_id > f.first),
g AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS gap FROM c),
i AS (SELECT doc_id, p, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
r AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, n),
s AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM r GROUP BY doc_id),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM r),
z AS (
  SELECT q.doc_id, q.a AS o, substr(d.x, (2 * q.from_ + 1)::BIGINT, (2 * (q.a - q.from_))::BIGINT) AS part FROM q JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, len(d.x), substr(d.x, (2 * coalesce(m.b, 0) + 1)::BIGINT) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY doc_id) m USING (doc_id)),
k AS (SELECT doc_id, string_agg(part, '' ORDER BY o) AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed, coalesce(s.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(k.kept)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL_OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL_OP9 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 3.0::DOUBLE AS most, (CASE (rk - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w
  FROM s),
q AS (SELECT *, most / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w FROM r),
f AS (
  SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level
  FROM q WINDOW b AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN ratio >= level THEN level END) OVER () * w, most)) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto <= rest THEN 1
                              WHEN upto - here <= rest AND upto - rest < rest - (upto - here) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

# DuckDB has no CRC-32: `tab` is its table by bytes, and each feature's bytes are folded over it.
SQL_OP11 = """
WITH tab AS (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t
  FROM range(256) r(n)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, 0 AS side
  FROM documents
  UNION ALL
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), 1
  FROM benchmark),
f AS (
  SELECT doc_id, side, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS x FROM d),
u AS (SELECT DISTINCT x FROM f),
h AS (
  SELECT x, xor(list_reduce(list_transform(range(octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM u, tab),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN h USING (x) GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM c, a),
z AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN h USING (x) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
o AS (
  SELECT d.doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN z USING (doc_id) WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n >= 20)
SELECT o.doc_id, o.n_features, o.weight, o.score, CASE WHEN r.rank <= (SELECT count(*) FROM r) * 5 // 100 THEN r.rank END AS rank
FROM o LEFT JOIN r USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_quality_model": op2_quality_model,
        "op3_sharding": op3_sharding,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_mixing": op9_mixing,
        "op10_secrets": op10_secrets,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_whitening": op12_whitening,
        "op13_nearest": op13_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": SQL_OP1, "op4_suffix_dedup": SQL_OP4, "op6_exact_dedup": SQL_OP6, "op9_mixing": SQL_OP9, "op11_importance_resampling": SQL_OP11}
