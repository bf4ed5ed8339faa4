"""The registry of queries, and SQL for the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(spark, sf_dir) under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


META = """meta AS (SELECT doc_id AS id, doc_id % 3 AS group_id, 1 + doc_id % 7 AS user_id, source AS category, 'doc_' || doc_id AS title,
 'doc_' || doc_id || '.txt' AS filename, sha256(text) AS hash_sha256, n_chars AS file_size,
 ['uploading','registered','running','uploaded','failed','skipped','ocr_required'][doc_id % 7 + 1] AS status,
 [doc_id % 5, doc_id % 11] AS role_ids, 1704067200 + (doc_id * 3571) % 2592000 AS start_date,
 1704067200 + (doc_id * 3571) % 2592000 + doc_id % 900 AS end_date, 1704067200 + (doc_id % 400) * 86400 AS expiration_date,
 len(regexp_extract_all(text, '\\S+')) // 2 AS token, n_chars * 1e-7 AS cost, n_chars * 2e-8 AS summary_cost FROM documents)"""

LOGS = """logs AS (SELECT event_id AS id, user_id, event_type AS action_type,
 ['/v1/documents/12','/v1/embeddings/retrieval','/health','/v1/costs/statistics','/docs'][event_id % 5 + 1] AS endpoint,
 ['GET','POST','PUT','DELETE'][event_id % 4 + 1] AS http_method,
 CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN 404 ELSE 200 END AS status_code,
 CASE WHEN event_type <> 'error' AND event_id % 13 <> 0 THEN 'SUCCESS' ELSE 'FAILED' END AS success,
 event_id % 1000 AS processing_time_ms, props AS action_details, 's' || (event_id % 50) AS session_id, ts AS created_at FROM events)"""

PROGRESS = """progress AS (SELECT CAST(event_id % 200 AS VARCHAR) AS task_id, user_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'c' || (event_id % 4) END AS category,
 event_type AS stage, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'in_progress' END AS status,
 CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id FROM events)"""
