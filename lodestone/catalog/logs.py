"""Audit logs and progress events; the batch definitions of what the streams keep."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..plans import jobs
from ..sources.tables import export_logs, shared_folder, write_csv
from ..sources.views import action_logs, progress
from ..streaming import ingest
from ..streaming import progress as R
from .base import LOGS, PROGRESS, query


def _l(sql: str) -> str:
    return f"WITH {LOGS} {sql}"


def _p(sql: str) -> str:
    return f"WITH {PROGRESS} {sql}"


@query(_l("SELECT id, user_id FROM logs WHERE action_type = 'view' AND success <> 'SUCCESS' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20'"))
def log_filter(spark, d):
    p = P.log_filter(action_type="view", start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 20), success=False)
    return action_logs(spark, d).where(p).select("id", "user_id")


@query(_l("SELECT id, endpoint FROM logs WHERE NOT contains(endpoint, '/health') AND NOT contains(endpoint, '/docs')"))
def logged_paths(spark, d):
    return action_logs(spark, d).where(P.logged_path(["/health", "/docs"])).select("id", "endpoint")


@query(_l("SELECT id, user_id, action_type, endpoint, http_method, status_code, success, session_id FROM logs ORDER BY created_at DESC, id DESC LIMIT 10000"))
def log_export(spark, d):
    return export_logs(action_logs(spark, d), ["id", "user_id", "action_type", "endpoint", "http_method", "status_code", "success", "session_id"])


@query(_l("SELECT id, action_type, endpoint, 'a \"' || session_id || '\", b' AS note FROM logs ORDER BY created_at DESC, id DESC LIMIT 10000"))
def log_export_csv(spark, d):
    """The export as one CSV file with a header, read back; a column has commas, quotes and line ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.csv"
    rows = action_logs(spark, d).withColumn("note", F.concat(F.lit('a "'), "session_id", F.lit('", b')))
    write_csv(export_logs(rows, ["id", "action_type", "endpoint", "note"]), path)
    return spark.read.options(header=True, escape='"', multiLine=True).schema("id long, action_type string, endpoint string, note string").csv(path)


_PATHS = ("", "/Upload", "/a/DOWNLOAD", "/x/WebSocket", "/Search/upload", "/v1/notifications/7")


@query(_l("""SELECT id, CASE WHEN contains(p, 'search') OR contains(p, 'retrieval') THEN 'SEARCH' WHEN contains(p, 'upload') THEN 'UPLOAD' WHEN contains(p, 'download') THEN 'DOWNLOAD' WHEN contains(p, 'websocket') OR starts_with(p, '/notifications/') THEN 'WEBSOCKET'
 WHEN m = 'GET' THEN 'READ' WHEN m = 'POST' THEN 'CREATE' WHEN m IN ('PUT', 'PATCH') THEN 'UPDATE' WHEN m = 'DELETE' THEN 'DELETE' ELSE 'UNKNOWN' END AS kind, outcome FROM (SELECT id,
 CASE WHEN id % 11 = 0 THEN '/notifications/' || id ELSE lower(endpoint || ['', '/Upload', '/a/DOWNLOAD', '/x/WebSocket', '/Search/upload', '/v1/notifications/7'][id % 6 + 1]) END AS p, CASE WHEN id % 7 = 0 THEN 'OPTIONS' WHEN id % 7 = 1 THEN 'PATCH' ELSE http_method END AS m,
 CASE WHEN status_code BETWEEN 200 AND 399 THEN 'SUCCESS' ELSE 'FAILED' END AS outcome FROM logs)"""))  # fmt: skip
def log_classes(spark, d):
    i = F.col("id")
    path = F.when(i % 11 == 0, F.concat(F.lit("/notifications/"), i.cast("string"))).otherwise(F.concat("endpoint", F.element_at(F.array(*map(F.lit, _PATHS)), (i % 6 + 1).cast("int"))))
    method = F.when(i % 7 == 0, "OPTIONS").when(i % 7 == 1, "PATCH").otherwise(F.col("http_method"))
    return action_logs(spark, d).select("id", S.action_type(method, path).alias("kind"), S.outcome("status_code").alias("outcome"))


@query(_l("SELECT id, CASE WHEN endpoint = '/v1/documents/12' THEN '/v1/documents/{id}' WHEN endpoint = '/v1/embeddings/retrieval' THEN '/v1/{area}/retrieval' END AS template FROM logs"))
def endpoint_templates(spark, d):
    templates = spark.createDataFrame([("/v1/documents/{id}",), ("/v1/{area}/retrieval",), ("/x.y/{a}/{b}",)], "template string")
    return S.match_templates(action_logs(spark, d), templates).select("id", "template")


@query(_l("""SELECT user_id, requests, sessions, types, CAST(least(requests * 2, 40) + floor(rate * 0.3) + least(sessions * 5, 20) + least(types * 2, 10) AS BIGINT) AS score FROM
 (SELECT user_id, count(*) AS requests, count(*) FILTER (success = 'SUCCESS') * 100.0 / count(*) AS rate, count(DISTINCT session_id) AS sessions, count(DISTINCT action_type) AS types FROM logs GROUP BY 1)"""))  # fmt: skip
def activity_score(spark, d):
    return A.activity_score(action_logs(spark, d))


@query(_l("SELECT id, session_id FROM logs WHERE created_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY"))
def log_retention(spark, d):
    return jobs.retain(action_logs(spark, d), dt.datetime(2024, 1, 20), 7)[0].select("id", "session_id")


@query(_l("SELECT count(*) AS deleted FROM logs WHERE created_at < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY"))
def log_retention_count(spark, d):
    return jobs.retain(action_logs(spark, d), dt.datetime(2024, 1, 20), 7)[1]


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def log_details(spark, d):
    return action_logs(spark, d).select(F.col("id").alias("event_id"), F.get_json_object(S.json_object("action_details"), "$.k").cast("bigint").alias("k"))


@query(_l("SELECT id, '{\"k\":\"[FILTERED]\"}' AS details FROM logs"))
def log_redaction(spark, d):
    return action_logs(spark, d).select("id", S.redact_flat("action_details", ["k"]).alias("details"))


@query(_l("SELECT session_id AS schedule_id, count(*) AS total_executions, count(*) FILTER (success = 'SUCCESS') AS successful, count(*) FILTER (success <> 'SUCCESS') AS failed, max(processing_time_ms) AS last_executed_at FROM logs GROUP BY 1"))
def schedule_counters(spark, d):
    h = action_logs(spark, d).select(F.col("session_id").alias("schedule_id"), F.lower("success").alias("status"), F.col("processing_time_ms").alias("started_at"))
    return A.schedule_counters(h)


@query(_l("SELECT id // 5 AS schedule_id, count(*) AS processed, count(*) FILTER (success = 'SUCCESS') AS success, count(*) FILTER (success <> 'SUCCESS') AS failed, CASE WHEN bool_and(success = 'SUCCESS') THEN 'success' ELSE 'failed' END AS status FROM logs GROUP BY 1"))
def run_outcomes(spark, d):
    rows = action_logs(spark, d).select(F.expr("id div 5").alias("schedule_id"), (F.col("success") == "SUCCESS").alias("ok"))
    return A.run_outcome(rows)


_DETAILS = "SELECT event_id AS item_id, event_type AS category, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 2 END AS b FROM events"


def _details(spark, d):
    from ..sources.tables import load

    v, i = F.col("value"), F.col("event_id")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return load(spark, d, "events").select(
        i.alias("item_id"), F.col("event_type").alias("category"), F.when(i % 11 == 0, nan).otherwise(v).alias("context_precision"), F.when(i % 7 == 0, inf).otherwise(v / 2).alias("context_recall"),
        F.when(i % 7 == 0, None).otherwise(v / 2).alias("faithfulness"), v.alias("answer_relevancy"),
    )


@query(f"WITH e AS ({_DETAILS}) SELECT round(avg(a), 6) AS context_precision, round(avg(b), 6) AS context_recall, round(avg(b), 6) AS faithfulness, round((SELECT avg(value) FROM events), 6) AS answer_relevancy FROM e")
def evaluation_summary(spark, d):
    return A.evaluation_means(_details(spark, d)).select(*[F.round(m, 6).alias(m) for m in A.METRICS])


@query(f"WITH e AS ({_DETAILS}) SELECT category, count(*) AS items, round(avg(a), 6) AS context_precision, round(avg(b), 6) AS context_recall FROM e GROUP BY 1")
def evaluation_by_category(spark, d):
    return A.evaluation_means(_details(spark, d), "category").select("category", "items", *[F.round(m, 6).alias(m) for m in A.METRICS[:2]])


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 5 < 2) AS selected, count(*) FILTER (event_id % 5 >= 2) AS saved, round(count(*) FILTER (event_id % 5 >= 2) / count(*) * 100, 2) AS rate, count(*) FILTER (event_id % 5 >= 2) * 256 AS saved_tokens, round(count(*) FILTER (event_id % 5 >= 2) * 256 / 1000 * 0.0001, 4) AS saved_usd FROM events")
def chunk_reduction(spark, d):
    return A.reduction(action_logs(spark, d).select((F.col("id") % 5 < 2).alias("is_relevant")))


def _responses(spark, d):
    i = F.col("id")
    return action_logs(spark, d).select("id", F.when(i % 3 == 0, "r").alias("response"), F.when(i % 5 == 0, " ").otherwise("a").alias("answer"))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'filled' END AS label, count(*) AS n FROM events GROUP BY 1")
def response_fill(spark, d):
    return A.fill_statistics(_responses(spark, d))


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 = 0")
def response_failures(spark, d):
    return A.fill_failures(_responses(spark, d))


@query(_l("SELECT id, CASE WHEN pending OR running THEN 'failed' ELSE status END AS status, CASE WHEN pending THEN 'not started in time' WHEN running THEN 'not completed in time' END AS error_message FROM (SELECT id, ['pending','running','completed'][id % 3 + 1] AS status, id % 3 = 0 AND id % 2 = 0 AND processing_time_ms < 300 AS pending, id % 3 = 1 AND processing_time_ms < 500 AS running FROM logs)"))
def stale_jobs(spark, d):
    i = F.col("id")
    rows = action_logs(spark, d).select(
        "id", F.element_at(F.array(*map(F.lit, ("pending", "running", "completed"))), (i % 3 + 1).cast("int")).alias("status"), F.when((i % 3 == 1) | (i % 2 == 1), F.col("processing_time_ms")).alias("started_at"),
        F.col("processing_time_ms").alias("created_at"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("bigint").alias("completed_at"),
    )
    return jobs.reap(rows, 300, 500, 10_000).select("id", "status", "error_message")


# ---- progress -------------------------------------------------------------------------------------------------------


@query(_p("SELECT task_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM progress GROUP BY 1"))
def latest_by_task(spark, d):
    return R.latest(progress(spark, d), ["task_id"]).select("task_id", "status", "ts")


@query(_p("SELECT user_id, task_id, arg_max(status, (ts, event_id)) AS status FROM progress GROUP BY 1, 2"))
def latest_by_user_document(spark, d):
    return R.latest(progress(spark, d), ["user_id", "task_id"]).select("user_id", "task_id", "status")


@query(_p("""SELECT user_id, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM (SELECT user_id, task_id, arg_max(status, (ts, event_id)) AS s FROM progress GROUP BY 1, 2) WHERE s = 'in_progress' GROUP BY 1"""))
def running_by_user(spark, d):
    return R.running_by_user(progress(spark, d)).select("user_id", F.array_join("tasks", ",").alias("tasks"))


@query(_p("""SELECT user_id, category, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM (SELECT user_id, category, task_id, arg_max(status, (ts, event_id)) AS s FROM progress WHERE category <> '' GROUP BY 1, 2, 3)
 WHERE s = 'in_progress' GROUP BY 1, 2"""))  # fmt: skip
def running_by_category(spark, d):
    return R.running_by_category(progress(spark, d)).select("user_id", "category", F.array_join("tasks", ",").alias("tasks"))


_LATE = "SELECT user_id FROM progress GROUP BY 1 HAVING max(ts) >= 1706000000 - 864000"


@query(_p(f"""SELECT user_id, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM (SELECT user_id, task_id, arg_max(status, (ts, event_id)) AS s FROM progress GROUP BY 1, 2) WHERE s = 'in_progress' AND user_id IN ({_LATE}) GROUP BY 1"""))
def running_by_user_unexpired(spark, d):
    """At a time, with a time to live that each event of the user renews."""
    return R.running_by_user(progress(spark, d), 1_706_000_000, 864_000).select("user_id", F.array_join("tasks", ",").alias("tasks"))


@query(_p("""SELECT user_id, category, string_agg(task_id, ',' ORDER BY task_id) AS tasks FROM (SELECT user_id, category, task_id, arg_max(status, (ts, event_id)) AS s FROM progress WHERE category <> '' GROUP BY 1, 2, 3)
 WHERE s = 'in_progress' AND (user_id, category) IN (SELECT (user_id, category) FROM progress WHERE category <> '' GROUP BY user_id, category HAVING max(ts) >= 1706000000 - 864000) GROUP BY 1, 2"""))  # fmt: skip
def running_by_category_unexpired(spark, d):
    return R.running_by_category(progress(spark, d), 1_706_000_000, 864_000).select("user_id", "category", F.array_join("tasks", ",").alias("tasks"))


@query(_p("SELECT task_id, 1706000000 - max(ts) <= 30 OR arg_max(status, (ts, event_id)) = 'in_progress' AS active FROM progress GROUP BY 1"))
def task_liveness(spark, d):
    return R.liveness(progress(spark, d), 1_706_000_000)


@query(_p("SELECT event_id, CASE WHEN stage = 'view' AND status = 'in_progress' THEN 'looking' ELSE stage || ' ' || status END AS description FROM progress"))
def stage_descriptions(spark, d):
    names = spark.createDataFrame([("view", "in_progress", "looking")], "stage string, status string, description string")
    return R.described(progress(spark, d), names).select("event_id", "description")


@query("""SELECT 't' || event_id AS task_id, CASE WHEN event_id % 3 = 0 THEN 'reports' ELSE 'general' END AS category, 'f' || event_id AS title, 'pdf' AS file_type, event_id % 4 <> 1 AS pipeline_separation, event_id % 6 <> 5 AS valid,
 CASE WHEN event_id % 6 <> 5 THEN user_id END AS user_id FROM events WHERE event_id % 10 <> 0""")  # fmt: skip
def upload_events(spark, d):
    """Upload bodies made from the events; every tenth is broken JSON and goes to the dead letters."""
    i = F.col("id").cast("string")
    user = F.when(F.col("id") % 6 != 5, F.concat(F.lit(',"user_info":{"passport_data":{"user_id":'), F.col("user_id").cast("string"), F.lit(',"groups":[2]}}'))).otherwise("")
    route = F.when(F.col("id") % 3 == 0, ',"routing_analysis":{"routing_key":"file.uploaded.reports"}').otherwise("")
    split = F.when(F.col("id") % 4 == 1, '"pipeline_separation":false').otherwise('"chunk_size":100')
    body = F.concat(F.lit('{"task_id":"t'), i, F.lit('","file_path":"/in/f'), i, F.lit('.PDF","metadata":{'), split, route, F.lit("}"), user, F.lit("}"))
    rows = action_logs(spark, d).select(F.when(F.col("id") % 10 == 0, "{broken").otherwise(body).alias("value"))
    decoded = ingest.decode(rows).where("task_id is not null")
    return decoded.select("task_id", "category", "title", "file_type", "pipeline_separation", "valid", "user_id")


@query("SELECT CAST(user_id AS VARCHAR) AS hash_sha256, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 <> 0) GROUP BY 1")
def stream_duplicates(spark, d):
    rows = progress(spark, d).select(F.lit(1).alias("group_id"), F.col("user_id").cast("string").alias("hash_sha256"), "event_id")
    known = rows.where("cast(hash_sha256 as bigint) % 5 = 0")
    fresh = ingest.without_duplicates(rows, known)
    return fresh.groupBy("hash_sha256").agg(F.count("*").alias("n"))
