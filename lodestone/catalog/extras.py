"""Listings, look-ups and joins of evaluations, schedules and dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import predicates as P
from ..functions import scalars as S
from ..functions.schedules import next_due
from ..operators import joins as J
from ..operators import vectors
from ..operators import windows as W
from ..plans import jobs
from ..sources import tables as T
from ..sources.tables import load
from ..sources.views import NOW, meta, progress, query_vectors
from ..streaming import progress as R
from . import splitting
from .base import META, PROGRESS, query


def _m(sql: str) -> str:
    return f"WITH {META} {sql}"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 OR (l_linenumber = 3 AND l_suppkey = 2)")
def chunk_filters(spark, d):
    li = load(spark, d, "lineitem")
    return li.where(P.equals(l_orderkey=7) | P.equals(l_linenumber=3, l_suppkey=2)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(_m("SELECT id FROM meta WHERE user_id = 4 AND status = 'uploaded'"))
def own_rows(spark, d):
    return meta(spark, d).where(P.all_of(P.owned(4, [2, 3]), P.status_is("uploaded"))).select("id")


@query(_m("SELECT id FROM meta WHERE status = 'registered' ORDER BY id LIMIT 30"))
def status_listing(spark, d):
    return meta(spark, d).where(P.status_is("registered")).orderBy("id").limit(30).select("id")


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0 AND o_custkey * 1000000 <= {NOW}")
def due_schedules(spark, d):
    rows = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "O").alias("is_active"), F.when(F.col("o_orderkey") % 5 == 0, NOW).alias("deleted_at"), (F.col("o_custkey") * 1_000_000).alias("scheduled_at")
    )
    return rows.where(P.due(NOW) & P.visible()).select("id")


@query("SELECT n_nationkey::BIGINT AS id, 'root' AS kind FROM nation WHERE n_nationkey < 4 UNION ALL SELECT n_nationkey, 'child' FROM nation WHERE n_nationkey >= 4 AND n_nationkey // 4 = 2")
def category_listing(spark, d):
    k = F.col("n_nationkey").cast("bigint")
    tree = load(spark, d, "nation").select(k.alias("id"), F.when(k >= 4, F.floor(k / 4)).alias("parent_id"))
    roots = tree.where(P.root_or_child(None)).select("id", F.lit("root").alias("kind"))
    return roots.union(tree.where(P.root_or_child(2)).select("id", F.lit("child")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey < 200) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def point_lookups(spark, d):
    ids = load(spark, d, "orders").where("o_orderkey < 200").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return load(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 ORDER BY s_suppkey LIMIT 100")
def dimension_listing(spark, d):
    rows = load(spark, d, "supplier").withColumn("role_ids", F.array((F.col("s_suppkey") % 3).cast("bigint")))
    return rows.where(P.has_role([1, 2])).orderBy("s_suppkey").limit(100).select("s_suppkey", "s_name")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q WHERE vec_id % 4 IN (1, 3)),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s)
 SELECT query_id, id, round(score, 6) AS score FROM h WHERE rank <= 5 AND score >= 0.3""")  # fmt: skip
def entity_top_k(spark, d):
    """Top-k under roles, then a similarity threshold."""
    e = load(spark, d, "embeddings").withColumn("role_ids", F.array(F.col("vec_id") % 4))
    hits = vectors.dense_top_k(query_vectors(spark, d), e.where(P.has_role([1, 3])), 5)
    return hits.where(P.score_at_least(0.3)).select("query_id", "id", F.round("score", 6).alias("score"))


@query(_m("SELECT o_orderkey AS item_id, hash_sha256 FROM orders LEFT JOIN (SELECT title, min(hash_sha256) AS hash_sha256 FROM meta WHERE list_has_any(role_ids, [1, 3]) AND expiration_date > 1718000000 GROUP BY title HAVING count(*) = 1) t ON t.title = 'doc_' || (o_orderkey % 400)"))
def evaluation_sources(spark, d):
    source = F.concat(F.lit("/golden/doc_"), (F.col("o_orderkey") % 400).cast("string"), F.lit(".pdf"))
    items = load(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), source.alias("source_document"))
    return J.source_hash(items, P.unique_title_hash(meta(spark, d), (1, 3), NOW), S.stem("source_document")).select("item_id", "hash_sha256")


@query("""SELECT o_orderkey AS item_id, coalesce(n, 0) AS num_results, t.texts, o_totalprice AS faithfulness FROM orders
 LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS texts FROM lineitem WHERE l_quantity > 25 GROUP BY 1) t ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0""")  # fmt: skip
def evaluation_rows(spark, d):
    o = load(spark, d, "orders")
    results = load(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("text"), F.lit(1).alias("page_number"))
    scores = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("faithfulness"))
    out = J.evaluation_rows(o.select(F.col("o_orderkey").alias("item_id")), results, scores)
    return out.select("item_id", "num_results", F.array_join("retrieved_chunks.text", "").alias("texts"), "faithfulness")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN 'p' || c_nationkey % 3 END AS prompt FROM customer")
def persona_prompts(spark, d):
    personas = load(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("persona_id")).distinct().withColumn("prompt", F.when(F.col("persona_id") > 0, F.concat(F.lit("p"), F.col("persona_id").cast("string"))).otherwise("  "))
    rows = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("persona_id"))
    return J.with_persona(rows, personas).select("c_custkey", "prompt")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE user_id % 7 = 3 AND event_type = 'view' AND event_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 40 OFFSET 20")
def evaluation_listing(spark, d):
    """A user's and group's evaluations, by status and mode where these are asked for, newest first, a page of them."""
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("user_id"), F.lit(1).alias("group_id"), F.col("event_type").alias("status"), (F.col("event_id") % 2).alias("eval_mode"), F.col("ts").alias("created_at"))
    found = rows.where(P.equals(user_id=3, group_id=1, status="view", eval_mode=0))
    return found.orderBy(F.desc("created_at"), "id").offset(20).limit(40).select("id", "created_at")


@query("SELECT c_custkey, s_suppkey % 3 > 0 AS active FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 200".replace("s_suppkey % 3 > 0", "coalesce(s_suppkey % 3 > 0, false)"))
def active_models(spark, d):
    """Whether the model that a row names is there and active."""
    models = load(spark, d, "supplier").select(F.col("s_suppkey").alias("model"), (F.col("s_suppkey") % 3 > 0).alias("is_active"))
    rows = load(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 200).alias("model"))
    return rows.join(J.small(models), "model", "left").select("c_custkey", F.coalesce("is_active", F.lit(False)).alias("active"))


@query("SELECT s_suppkey AS id, s_name AS model_name FROM supplier WHERE s_suppkey % 3 > 0")
def active_model_listing(spark, d):
    models = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("model_name"), (F.col("s_suppkey") % 3 > 0).alias("is_active"))
    return models.where("is_active").orderBy("id").select("id", "model_name")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 1718002800 WHEN c_custkey % 4 = 2 THEN 1718076600 ELSE 1718496000 END AS scheduled_at, c_custkey % 4 <> 0 AS is_active FROM customer WHERE c_custkey % 5 <> 0
 UNION ALL SELECT c_custkey, 1718000001, true FROM customer WHERE c_custkey % 5 = 0""".replace("THEN NULL", f"THEN {NOW}"))  # fmt: skip
def schedule_ticks(spark, d):
    """Due schedules without a cron expression are switched off, hourly, daily and weekly ones get their next time; those not yet due stay."""
    k = F.col("c_custkey")
    cron = F.when(k % 4 == 1, "0 * * * *").when(k % 4 == 2, "30 3 * * *").when(k % 4 == 3, "0 0 * * 0")
    rows = load(spark, d, "customer").select(k.alias("id"), cron.alias("cron_expression"), F.when(k % 5 == 0, F.lit(NOW + 1)).otherwise(F.lit(NOW)).cast("bigint").alias("scheduled_at"), F.lit(True).alias("is_active"), F.lit(None).cast("bigint").alias("deleted_at"))
    return jobs.advance(rows, NOW).select("id", "scheduled_at", "is_active")


@query(f"WITH {PROGRESS} SELECT user_id, task_id, arg_max(stage, (ts, event_id)) AS stage FROM progress GROUP BY 1, 2 HAVING arg_max(status, (ts, event_id)) = 'in_progress'")
def running_snapshot(spark, d):
    """What a new listener is sent first: the state of every running task."""
    last = R.latest(progress(spark, d), ["user_id", "task_id"])
    return last.where(~F.col("status").isin(*R.TERMINAL)).select("user_id", "task_id", "stage")


@query(f"""WITH RECURSIVE {splitting.pieces("SELECT doc_id AS key, text FROM documents", 500, 50)}
 SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY path, k) - 1 AS INT) AS chunk_index, text AS chunk FROM pieces""")
def split_chunks_sql(spark, d):
    """The recursive splitter as a table function in SQL."""
    chunking.register_splitter(spark)
    docs = load(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, c.chunk_index, c.chunk FROM {docs}, LATERAL split_chunks(text, 500, 50) AS c", docs=docs)


#: Expressions of schedules, and for each in SQL which minutes (t, a timestamp) it names.
_CRONS = {
    "*/17 3-5,22 * * *": "extract(minute FROM t) % 17 = 0 AND extract(hour FROM t) IN (3, 4, 5, 22)",
    "5,50 9-17/4 * * mon-fri": "extract(minute FROM t) IN (5, 50) AND extract(hour FROM t) IN (9, 13, 17) AND extract(dow FROM t) BETWEEN 1 AND 5",
    "0 0 13 * 5": "extract(minute FROM t) = 0 AND extract(hour FROM t) = 0 AND (extract(day FROM t) = 13 OR extract(dow FROM t) = 5)",
    "30 6 31 */2 *": "extract(minute FROM t) = 30 AND extract(hour FROM t) = 6 AND extract(day FROM t) = 31 AND extract(month FROM t) % 2 = 1",
    "15 12 1-7 feb,nov *": "extract(minute FROM t) = 15 AND extract(hour FROM t) = 12 AND extract(day FROM t) <= 7 AND extract(month FROM t) IN (2, 11)",
    "0 24 * * *": "false",
}


@query(f"""WITH m AS (SELECT TIMESTAMP '1970-01-01' + to_minutes(g) AS t FROM (SELECT unnest(range({NOW} // 60 + 1, {NOW} // 60 + 527040)) AS g)),
 x AS ({" UNION ALL ".join(f"SELECT {k} AS k, min(t) AS t FROM m WHERE {w}" for k, w in enumerate(_CRONS.values()))})
 SELECT c_custkey AS id, CAST(epoch(t) AS BIGINT) AS next_at FROM customer JOIN x ON k = c_custkey % {len(_CRONS)}""")  # fmt: skip
def schedule_times(spark, d):
    """The next time of lists, ranges, steps, days of month beside weekdays, months; null where no time is named."""
    k = F.col("c_custkey")
    cron = F.element_at(F.array(*map(F.lit, _CRONS)), (k % len(_CRONS) + 1).cast("int"))
    return load(spark, d, "customer").select(k.alias("id"), next_due(cron, NOW).alias("next_at"))


@query(_m("SELECT id, file_size, page, (SELECT count(*) FROM meta) AS total FROM (SELECT id, file_size, (row_number() OVER (ORDER BY file_size DESC, id) - 1) // 40 AS page FROM meta) WHERE page < 4"))
def seek_pages(spark, d):
    """Four pages, each going on from the last row of the one before; the number of all rows is counted as a page is read."""
    m, after, out = meta(spark, d).select("id", "file_size"), None, None
    for page in range(4):
        rows, seen = W.page_after(m, [("file_size", True), ("id", False)], 40, after)
        got = rows.collect()  # a page
        one = spark.createDataFrame([(r.id, r.file_size, page, seen.get["total"]) for r in got], "id long, file_size long, page long, total long")
        out = one if out is None else out.union(one)
        if len(got) < 40:
            break
        after = got[-1].asDict()
    return out


@query("SELECT c_nationkey, count(*) AS files, max(octet_length(encode(t))) AS file_size, sha256(max(t)) AS hash_sha256 FROM (SELECT c_nationkey, string_agg(c_name || ',' || c_mktsegment, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY 1) GROUP BY 1")
def raw_files(spark, d):
    """Files written by nation, then listed with their size and digest as raw uploads are."""
    path = f"{T.shared_folder(spark)}/{uuid.uuid4().hex}"
    rows = load(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("value"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(path)
    found = T.raw_files(spark, f"{path}/*/*.txt").withColumn("c_nationkey", F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int"))
    return found.groupBy("c_nationkey").agg(F.count("*").alias("files"), F.max("file_size").alias("file_size"), F.max("hash_sha256").alias("hash_sha256"))


@query(f"WITH {PROGRESS} SELECT task_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM progress GROUP BY 1")
def latest_written(spark, d):
    """The events as a stream, whose latest states are written batch by batch, and read back."""
    path, rows = f"{T.shared_folder(spark)}/{uuid.uuid4().hex}", progress(spark, d)
    rows.write.parquet(f"{path}/events")
    events = spark.readStream.schema(rows.schema).parquet(f"{path}/events")
    q = R.write_latest(events, f"{path}/latest", f"{path}/checkpoint", ["task_id"])
    q.awaitTermination()
    return R.latest(spark.read.parquet(f"{path}/latest").drop("batch_id"), ["task_id"]).select("task_id", "status", "ts")
