"""Readers of the given tables, and the record, judgement, event and chunk tables that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scholarly records from `documents`, whose first line is the title and all after it the abstract; the same SQL runs on
#: DuckDB, for the oracles.
PAPERS = """
SELECT doc_id AS ord,
       CASE doc_id % 3 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'openalex' ELSE 'semantic_scholar' END AS source,
       'p' || CAST(doc_id AS STRING) AS id,
       split_part(text, chr(10), 1) AS title,
       substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(1990 + doc_id % 36 AS INT) END AS year,
       CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.1000/X' || CAST(doc_id % 97 AS STRING)
                       WHEN 1 THEN '10.48550/arXiv.2401.' || lpad(CAST(doc_id % 89 AS STRING), 5, '0')
                       WHEN 2 THEN '' ELSE NULL END AS doi,
       CASE WHEN doc_id % 5 < 2 THEN '2401.' || lpad(CAST(doc_id % 89 AS STRING), 5, '0') || 'v' || CAST(doc_id % 3 + 1 AS STRING) ELSE NULL END AS arxiv_id,
       CASE WHEN doc_id % 7 = 0 THEN 'https://x.org/' || CAST(doc_id AS STRING) || '.pdf' ELSE '' END AS pdf_url,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST((doc_id * 7919) % 1000 AS INT) END AS cited_by
FROM documents
"""

#: Judged lists from `embeddings`: a case for every 20 vectors.
JUDGED = """
SELECT CAST(floor(vec_id / 20) AS BIGINT) AS case_id, CAST(vec_id % 20 + 1 AS INT) AS rn,
       CAST(CASE WHEN CAST(floor(vec_id / 20) AS BIGINT) % 9 = 0 THEN 2 ELSE label % 5 END AS DOUBLE) AS score
FROM embeddings
"""

#: Cases of an evaluation suite from `orders`.
CASES = """
SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 17 = 0 THEN 'infra_error' ELSE 'ok' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'judge_failed' ELSE 'ok' END AS judge_status,
       o_orderkey % 7 = 0 AS saturated,
       CAST(o_orderkey % 101 AS DOUBLE) / 100 AS ndcg, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS precision,
       CAST(o_orderkey % 13 AS DOUBLE) - 6 AS gap, CAST(o_orderkey % 4 AS DOUBLE) / 3 AS recall,
       CAST(o_totalprice AS DOUBLE) AS latency
FROM orders
"""

#: Session events from `events`: a session per user, a turn per five events.
LOG = """
SELECT event_id, user_id AS session_id, ts, event_type, value,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_no,
       CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) AS BIGINT) AS turn
FROM events
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """One of the statements above over the tables that it names."""
    return spark.sql(sql.replace("FROM " + tables[0], "FROM {src}"), src=table(spark, sf_dir, tables[0]))
