"""Registration, embedding, rollback and maintenance jobs on the document table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..plans import jobs
from ..sources.tables import append, load, scan, shared_folder, write_counted, write_evaluation
from ..sources.views import NOW, meta
from . import splitting
from .base import META, query


def _m(sql: str) -> str:
    return f"WITH {META} {sql}"


def _chunks(spark, d):
    """Slices of 1000 characters of each distinct text as chunk rows."""
    from ..functions.chunking import plain_chunks

    docs = load(spark, d, "documents").select(F.sha2("text", 256).alias("hash_sha256"), "text").dropDuplicates(["hash_sha256"])
    return plain_chunks(docs, 1_000).select("hash_sha256", "chunk_index", F.col("text").alias("parsed_text"))


_CH = """ch AS (SELECT hash_sha256, text, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS chunk_index FROM (SELECT DISTINCT sha256(text) AS hash_sha256, text FROM documents)),
 ck AS (SELECT hash_sha256, chunk_index, substring(text, chunk_index * 1000 + 1, 1000) AS parsed_text FROM ch)"""


@query(_m(f"""SELECT id, group_id, user_id, category, title, filename, hash_sha256, file_size, role_ids[1] AS role, start_date, {NOW}::BIGINT AS end_date, expiration_date, 'registered' AS status, 'txt' AS file_type, '' AS summary, 0 AS persona_id, 1536 AS zeros, 0 AS counters,
 CASE WHEN id % 4 = 1 THEN 900 ELSE 500 END AS chunk_size, CASE WHEN id % 4 = 1 THEN 0 ELSE 50 END AS chunk_overlap, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS enable_pii_anonymization, CASE WHEN id % 3 = 0 THEN 'email,phone' END AS pii_types, CASE WHEN id % 3 = 0 THEN 'mask' END AS anonymization_strategy
 FROM (SELECT min(id) AS id, group_id, hash_sha256 FROM meta WHERE id % 2 = 1 GROUP BY 2, 3) f JOIN meta USING (id, group_id, hash_sha256) WHERE NOT EXISTS (SELECT 1 FROM meta o WHERE o.id % 2 = 0 AND o.group_id = f.group_id AND o.hash_sha256 = f.hash_sha256)"""))  # fmt: skip
def register_documents(spark, d):
    m = meta(spark, d)
    files = m.where("id % 2 = 1").withColumns({
        "chunking": F.when(F.col("id") % 4 == 1, "semantic").otherwise("fixed"), "max_chunk_size": F.lit(900), "enable_pii_anonymization": F.col("id") % 3 == 0,
        "pii_types": F.array(F.lit("email"), F.lit("phone")), "pii_strategy": F.lit("mask"),
    })
    new = jobs.register(files, m.where("id % 2 = 0"), NOW)
    counters = sum((F.col(c) for c in ("chunk_count", "token", "summary_token", "original_chunk_count", "filtered_chunk_count", "embedding_start_date", "embedding_end_date", "cost")), F.col("summary_cost"))
    same = ("id", "group_id", "user_id", "category", "title", "filename", "hash_sha256", "file_size", "start_date", "end_date", "expiration_date", "status", "file_type", "summary", "persona_id", "chunk_size", "chunk_overlap", "enable_pii_anonymization", "pii_types", "anonymization_strategy")
    return new.select(*same, F.element_at("role_ids", 1).alias("role"), F.size(F.filter("embedding_value", lambda x: x == 0)).alias("zeros"), counters.cast("bigint").alias("counters"))


@query(_m(f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'uploaded' WHEN id % 5 = 1 THEN 'failed' WHEN id % 5 = 2 THEN 'skipped' ELSE status END AS status, CASE WHEN id % 5 IN (0, 2) THEN id % 100 ELSE token END AS token, CASE WHEN id % 5 IN (0, 2) THEN {NOW} ELSE end_date END AS end_date,
 CASE WHEN id % 5 IN (0, 2) AND id % 3 > 0 THEN id % 3 ELSE 9 END AS persona_id FROM meta"""))  # fmt: skip
def final_status(spark, d):
    """Runs that end as uploaded or skipped leave their counters; failed ones only their status."""
    m = meta(spark, d).withColumn("hash_sha256", F.col("id").cast("string")).withColumn("persona_id", F.lit(9).cast("bigint"))
    k = F.col("id") % 5
    runs = m.where("id % 5 < 3").select("hash_sha256", F.when(k == 0, "uploaded").when(k == 1, "failed").otherwise("skipped").alias("status"), (F.col("id") % 100).alias("token"), (F.col("id") % 3).alias("persona_id"))
    return jobs.final_status(m, runs, NOW).select("id", "status", "token", "end_date", "persona_id")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE s_name END AS description, CASE WHEN s_suppkey % 4 = 1 THEN 'b' ELSE 'a' END AS synonyms, s_suppkey % 4 < 2 AS embedded FROM supplier""")
def edit_relations(spark, d):
    """New descriptions, new synonyms and edits that change neither: only the first two make a new vector."""
    k = F.col("s_suppkey")
    t = load(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("r"), k.cast("string")).alias("relation_type"), F.col("s_name").alias("description"), F.array(F.lit("a")).alias("synonyms"), F.lit(None).cast("array<float>").alias("embedding"))
    edits = t.where("id % 4 < 3").select("id", F.when(F.col("id") % 4 == 0, "new").otherwise(F.col("description")).alias("description"), F.when(F.col("id") % 4 == 1, F.array(F.lit("b"))).otherwise(F.col("synonyms")).alias("synonyms"))
    return jobs.edit_relations(t, edits).select("id", "description", F.element_at("synonyms", 1).alias("synonyms"), F.col("embedding").isNotNull().alias("embedded"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query(_m("SELECT group_id, status, count(*) AS n, (SELECT count(*) FROM meta WHERE id % 2 = 0) AS counted FROM meta GROUP BY 1, 2"))
def appended_rows(spark, d):
    """Two writes of a table, the first counted against what is expected, the second appended by group; then the table's counts."""
    m, path = meta(spark, d), _folder(spark)
    even = m.where("id % 2 = 0")
    n = write_counted(even, path, even.count(), mode="append", partition_by=("group_id",))
    append(m.where("id % 2 = 1"), path)
    return scan(spark, path).groupBy(F.col("group_id").cast("bigint").alias("group_id"), "status").agg(F.count("*").alias("n")).withColumn("counted", F.lit(n).cast("bigint"))


@query("SELECT o_orderstatus AS id, (SELECT count(*) FROM orders) AS item_count, count(*) AS n, sum(o_custkey) AS score FROM orders GROUP BY 1")
def evaluation_sink(spark, d):
    """An evaluation's details and its header with their number, written and read back."""
    path = _folder(spark)
    details = load(spark, d, "orders").select(F.col("o_orderstatus").alias("id"), "o_orderkey", F.col("o_custkey").alias("score"))
    write_evaluation(details.select("id").distinct(), details, path)
    found = scan(spark, f"{path}/evaluation_details").groupBy("id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return scan(spark, f"{path}/evaluations").join(found, "id").select("id", F.col("item_count").cast("bigint").alias("item_count"), "n", "score")


def _generated(spark, d):
    pages = load(spark, d, "documents").select(F.sha2("text", 256).alias("hash_sha256"), F.lit(1).alias("page_number"), "text").dropDuplicates(["hash_sha256"])
    ready = meta(spark, d).where("status = 'registered'").groupBy("hash_sha256").agg(F.min_by(F.struct("group_id", "role_ids", "category", "title", "filename", "status"), "id").alias("r")).select("hash_sha256", "r.*")
    return jobs.make_chunks(ready, pages, "run-1", 500, 50)


@query()
def generate_embeddings(spark, d):
    return _generated(spark, d).select("chunk_id", "hash_sha256", "chunk_index", "parsed_text", "token")


@query(f"""WITH RECURSIVE {META}, ready AS (SELECT hash_sha256, arg_min(struct_pack(group_id := group_id, category := category, title := title), id) AS r FROM meta WHERE status = 'registered' GROUP BY hash_sha256),
 {splitting.pieces("SELECT DISTINCT sha256(text) AS key, text FROM documents WHERE sha256(text) IN (SELECT hash_sha256 FROM ready)", 500, 50)}
 SELECT hash_sha256, r.group_id AS group_id, r.category AS category, r.title AS title, row_number() OVER (PARTITION BY hash_sha256 ORDER BY path, k) - 1 AS chunk_index, text AS parsed_text,
 len(regexp_extract_all(text, '\\S+')) // 2 AS token, 64 AS dimension FROM pieces JOIN ready ON hash_sha256 = key""")  # fmt: skip
def generated_chunks(spark, d):
    """The chunks of a run with what they take over from their documents, and the length of their vectors."""
    return _generated(spark, d).select("hash_sha256", "group_id", "category", "title", "chunk_index", "parsed_text", "token", F.size("embedding").alias("dimension"))


@query(_m("""SELECT id, CASE WHEN hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE status = 'registered') THEN 'uploaded' ELSE status END AS status, true AS counted,
 hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE status = 'registered') AS indexed FROM meta"""))  # fmt: skip
def embedding_run(spark, d):
    """One run into both stores: each document's final status, whether its counter is the number of its stored chunks, and whether it has keyword rows."""
    m = meta(spark, d).withColumns({c: F.lit(0).cast("bigint") for c in ("chunk_count", "original_chunk_count", "filtered_chunk_count")})
    pages = load(spark, d, "documents").select(F.sha2("text", 256).alias("hash_sha256"), F.lit(1).alias("page_number"), "text").dropDuplicates(["hash_sha256"])
    path = _folder(spark)
    out = jobs.embedding_run(m, pages, path, "run-1", NOW)
    stored = scan(spark, f"{path}/chunks").groupBy("hash_sha256").agg(F.count("*").alias("n"))
    words = scan(spark, f"{path}/postings").select("hash_sha256").distinct().withColumn("words", F.lit(True))
    both = out.join(stored, "hash_sha256", "left").join(words, "hash_sha256", "left")
    return both.select("id", "status", (F.col("chunk_count") == F.coalesce("n", F.lit(0))).alias("counted"), F.coalesce("words", F.lit(False)).alias("indexed"))


@query(f"""WITH {_CH}, w AS (SELECT hash_sha256, chunk_index, unnest(regexp_extract_all(lower(parsed_text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ck)
 SELECT hash_sha256 || '_' || chunk_index AS doc_key, count(DISTINCT term) AS terms, count(*) AS words FROM w GROUP BY 1""")  # fmt: skip
def chunk_postings(spark, d):
    return jobs.index_postings(_chunks(spark, d)).groupBy("doc_key").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


@query(_m(f"""SELECT hash_sha256, CAST(sum(length(parsed_text)) AS BIGINT) AS token, count(*) AS chunks FROM ({_CH.replace("ch AS", "WITH ch AS", 1)} SELECT * FROM ck) GROUP BY 1"""))
def chunk_totals(spark, d):
    from ..operators.aggregates import document_totals

    rows = _chunks(spark, d).select("hash_sha256", F.length("parsed_text").alias("token"), F.lit(0.0).alias("cost"))
    return document_totals(rows).select("hash_sha256", "token", "chunks")


_BACK = """good AS (SELECT hash_sha256 FROM meta WHERE list_has_any(role_ids, [1, 3]) AND hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 5 = 0)
 GROUP BY 1 HAVING bool_or(status IN ('uploaded','failed','running','ocr_required','skipped')))"""


@query(_m(f"SELECT id, CASE WHEN g.hash_sha256 IS NULL THEN status ELSE 'registered' END AS status, CASE WHEN g.hash_sha256 IS NULL THEN token ELSE 0 END AS token, end_date FROM meta LEFT JOIN good g USING (hash_sha256)").replace(" SELECT id, CASE WHEN g.", f", {_BACK} SELECT id, CASE WHEN g.", 1))
def rollback_meta(spark, d):
    m = meta(spark, d)
    return _roll(spark, d, m)[0].select("id", "status", "token", "end_date")


def _roll(spark, d, m):
    ck = _chunks(spark, d)
    return jobs.roll_back(m, ck, ck.select("hash_sha256", "chunk_index"), m.where("id % 5 = 0"), (1, 3))


@query(f"WITH {META}, {_BACK}, {_CH} SELECT hash_sha256, chunk_index FROM ck WHERE hash_sha256 NOT IN (SELECT hash_sha256 FROM good)")
def rollback_chunks(spark, d):
    return _roll(spark, d, meta(spark, d))[1].select("hash_sha256", "chunk_index")


@query(f"WITH {_CH} SELECT hash_sha256, chunk_index FROM ck WHERE chunk_index % 2 = 0")
def undo_run(spark, d):
    ck = _chunks(spark, d).withColumn("run_id", F.concat(F.lit("r"), (F.col("chunk_index") % 2).cast("string")))
    return jobs.undo_run(ck, ck.select("hash_sha256", "chunk_index"), "r1")[1]


@query(f"WITH {META}, {_CH} SELECT hash_sha256, chunk_index FROM ck WHERE hash_sha256 NOT IN (SELECT hash_sha256 FROM meta WHERE list_has_any(role_ids, [1, 3]) AND hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 10 = 3))")
def delete_documents(spark, d):
    m, ck = meta(spark, d), _chunks(spark, d)
    return jobs.delete_documents(m, ck, ck, m.where("id % 10 = 3"), (1, 3))[1].select("hash_sha256", "chunk_index")


@query(f"WITH {_CH} SELECT hash_sha256 || chunk_index AS chunk_id, CASE WHEN chunk_index = 0 THEN 'edited' ELSE parsed_text END AS parsed_text, CASE WHEN chunk_index = 0 THEN 0::BIGINT ELSE 7 END AS token FROM ck")
def edit_chunks(spark, d):
    ck = _chunks(spark, d).select(F.concat("hash_sha256", F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "parsed_text", F.lit(7).cast("bigint").alias("token"), F.lit(0.0).alias("cost"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    edits = ck.where("chunk_index = 0").select("chunk_id", F.lit("edited").alias("parsed_text"))
    return jobs.edit_chunks(ck, edits).select("chunk_id", "parsed_text", "token")


@query(f"""WITH {_CH}, e AS (SELECT hash_sha256, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 'Edited chunk ' || substring(parsed_text, 1, 200) ELSE parsed_text END AS t FROM ck),
 w AS (SELECT hash_sha256, chunk_index, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) AS term FROM e) SELECT hash_sha256 || '_' || chunk_index AS doc_key, term, count(*) AS tf FROM w GROUP BY 1, 2""")  # fmt: skip
def edit_chunk_postings(spark, d):
    """Keyword rows after chunk edits: those of the changed chunks are made again, the others stay."""
    ck = _chunks(spark, d).select(F.concat("hash_sha256", F.col("chunk_index").cast("string")).alias("chunk_id"), "hash_sha256", "chunk_index", "parsed_text", F.lit(7).cast("bigint").alias("token"), F.lit(0.0).alias("cost"), F.array(F.lit(0.0).cast("float")).alias("embedding"))
    edits = ck.where("chunk_index % 3 = 0").select("chunk_id", F.concat(F.lit("Edited chunk "), F.substring("parsed_text", 1, 200)).alias("parsed_text"))
    return jobs.edit_chunks_indexed(ck, jobs.index_postings(ck), edits)[1].select("doc_key", "term", "tf")


@query(_m("SELECT id, CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 4 = 1 THEN title ELSE title END AS summary, id % 4 = 0 AS embedded FROM meta"))
def edit_meta(spark, d):
    m = meta(spark, d).select("id", F.col("title").alias("summary"), F.lit(None).cast("array<float>").alias("embedding"))
    edits = m.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "new").otherwise(F.col("summary")).alias("summary"))
    return jobs.edit_meta(m, edits).select("id", "summary", F.col("embedding").isNotNull().alias("embedded"))


@query(_m("SELECT id, CASE WHEN hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 9 = 0) THEN 'skipped' ELSE status END AS status FROM meta"))
def set_status(spark, d):
    m = meta(spark, d)
    return jobs.set_status(m, m.where("id % 9 = 0"), "skipped").select("id", "status")


@query(_m("SELECT count(*) AS before, count(*) AS after, true AS same FROM meta"))
def status_change_check(spark, d):
    m = meta(spark, d)
    return jobs.status_change_check(m, jobs.set_status(m, m.where("id % 9 = 0"), "skipped"))


@query(_m("SELECT id, CASE WHEN user_id = 3 AND id % 2 = 1 THEN 'deleted' ELSE 'failed' END AS outcome FROM meta WHERE id % 3 = 0"))
def soft_delete(spark, d):
    rows = meta(spark, d).select("id", "user_id", F.when(F.col("id") % 2 == 0, F.lit(1).cast("bigint")).alias("deleted_at"))
    return jobs.soft_delete(rows, rows.where("id % 3 = 0"), 3, NOW)[1]


@query("SELECT c_mktsegment AS name, min(c_name) AS description FROM customer GROUP BY 1 UNION SELECT 'BASE', 'given'")
def get_or_create(spark, d):
    given = spark.range(1).select(F.lit("BASE").alias("name"), F.lit("given").alias("description"))
    wanted = load(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("description"))
    return jobs.get_or_create(given, wanted, "name")


@query(_m("SELECT id, CASE WHEN status = 'running' THEN 'running' WHEN id % 4 = 0 THEN 'has_children' END AS reason FROM meta WHERE status = 'running' OR id % 4 = 0").replace("WHEN status = 'running' THEN 'running' WHEN id % 4 = 0 THEN 'has_children'", "WHEN id % 4 = 0 THEN 'has_children' ELSE 'running'"))
def guarded_delete(spark, d):
    m = meta(spark, d)
    bad = {"running": m.where("status = 'running'"), "has_children": m.where("id % 4 = 0")}
    return jobs.guarded(m.select("id"), bad, "id")[1]


@query(_m("""SELECT r.hash_sha256, CASE WHEN NOT ok THEN 'wrong_status' END AS reason, id, title FROM (SELECT hash_sha256, bool_or(status = 'registered') AS ok FROM meta GROUP BY 1) r
 LEFT JOIN (SELECT hash_sha256, min(id) AS id, arg_min(title, id) AS title FROM meta WHERE status = 'registered' GROUP BY 1) m USING (hash_sha256)
 WHERE r.hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 3 = 0)"""))  # fmt: skip
def ready_for_embedding(spark, d):
    m = meta(spark, d)
    return jobs.ready_for_embedding(m.where("id % 3 = 0"), m).select("hash_sha256", "reason", "id", "title")


@query(f"WITH {_CH} SELECT CASE WHEN chunk_index % 3 = 0 THEN 'chunks_only' ELSE 'both' END AS side, count(*) AS n FROM ck GROUP BY 1")
def store_consistency(spark, d):
    ck = _chunks(spark, d)
    return J.consistency(ck, ck.where("chunk_index % 3 != 0"))


@query(_m("SELECT DISTINCT 's' || id % 4 AS schedule_id, hash_sha256 FROM meta WHERE id % 4 <> 3 AND hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE status = 'registered')"))
def due_documents(spark, d):
    m = meta(spark, d)
    rows = m.groupBy((F.col("id") % 4).alias("s"), F.expr("id div 400").alias("_p")).agg(F.collect_list("hash_sha256").alias("document_hashes"))
    plans = rows.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("id"), "document_hashes", F.lit(True).alias("is_active"), F.lit(None).cast("bigint").alias("deleted_at"), F.when(F.col("s") == 3, NOW + 1).otherwise(NOW - 1).alias("scheduled_at"))
    return jobs.due_work(plans, m, NOW)[0].distinct()
