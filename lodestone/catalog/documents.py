"""Filters, joins, aggregates, rankings and listings of the document table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import tables as T
from ..sources.views import NOW, meta
from .base import META, query

ROLES = (1, 3)
_ROLE_SQL = "list_has_any(role_ids, [1, 3])"
_STAT = "count(*) FILTER (status = '{0}') AS {0}"
_STATS = ", ".join(_STAT.format(s) for s in ("uploading", "registered", "running", "uploaded", "failed", "skipped", "ocr_required"))


def _m(sql: str) -> str:
    return f"WITH {META} {sql}"


@query(_m("SELECT id, title, status FROM meta WHERE group_id = 1 AND file_size > 2000"))
def scan_filtered(spark, d):
    return meta(spark, d).where("group_id = 1 and file_size > 2000").select("id", "title", "status")


@query(_m(f"SELECT id, title FROM meta WHERE {_ROLE_SQL}"))
def filter_roles(spark, d):
    return meta(spark, d).where(P.has_role(ROLES)).select("id", "title")


@query(_m(f"SELECT id FROM meta WHERE {_ROLE_SQL} AND expiration_date > {NOW}"))
def filter_unexpired(spark, d):
    return meta(spark, d).where(P.has_role(ROLES) & P.unexpired(NOW, user_id=2)).select("id")


@query(_m("SELECT id FROM meta WHERE expiration_date >= 1718064000"))
def filter_unexpired_keyword(spark, d):
    return meta(spark, d).where(P.unexpired_keyword(1_718_064_000)).select("id")


@query(_m("SELECT id, category, title FROM meta WHERE contains(category, 'rc1') AND contains(title, 'doc_1') AND contains(filename, '5.txt')"))
def filter_contains(spark, d):
    p = P.all_of(P.contains("category", "rc1"), P.contains("title", "DOC_1", lower=True), P.contains("filename", "5.txt"))
    return meta(spark, d).where(p).select("id", "category", "title")


@query("SELECT doc_id, position('the %' IN text) > 0 AS hit FROM documents WHERE contains(text, '100%') OR contains(text, 'and_') OR contains(text, 'that')")
def filter_literal_keyword(spark, d):
    p = P.contains("text", "100%") | P.contains("text", "and_") | P.contains("text", "that")
    return T.load(spark, d, "documents").where(p).select("doc_id", F.col("text").contains("the %").alias("hit"))


@query(_m("SELECT id FROM meta WHERE hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 50 = 0)"))
def filter_hash_list(spark, d):
    m = meta(spark, d)
    return m.join(m.where("id % 50 = 0").select("hash_sha256").distinct(), "hash_sha256", "left_semi").select("id")


@query(_m("SELECT id FROM meta WHERE status = 'failed' AND user_id = 5"))
def filter_status(spark, d):
    return meta(spark, d).where(P.status_is("failed") & P.equals(user_id=5)).select("id")


@query(_m("SELECT title, min(hash_sha256) AS hash_sha256 FROM meta WHERE list_has_any(role_ids, [1, 3]) AND expiration_date > 1718000000 GROUP BY title HAVING count(*) = 1"))
def unique_title_lookup(spark, d):
    return P.unique_title_hash(meta(spark, d), ROLES, NOW)


@query(_m(f"SELECT id, expiration_date FROM meta WHERE expiration_date > {NOW} AND expiration_date <= {NOW} + 7 * 86400"))
def expiring_soon(spark, d):
    return meta(spark, d).where(P.expiring(NOW, 7)).select("id", "expiration_date")


@query(_m("SELECT id, file_size FROM meta WHERE group_id = 2 AND file_size BETWEEN 100 AND 4000 ORDER BY id LIMIT 20 OFFSET 20"))
def free_predicate_page(spark, d):
    rows = meta(spark, d).where(F.expr("group_id = 2 and file_size between 100 and 4000"))
    return W.page_of(rows, ["id"], 2, 20).select("id", "file_size")


@query(_m("SELECT id FROM meta WHERE group_id = 1 AND status = 'running' AND category = 'src3'"))
def equality_filters(spark, d):
    return meta(spark, d).where(P.matches({"group_id": 1, "status": "running", "category": "src3"})).select("id")


@query("SELECT vec_id, label FROM embeddings")
def without_vector(spark, d):
    return P.without(T.load(spark, d, "embeddings"), "embedding")


@query(_m("SELECT sha256(text) AS hash_sha256, sha256(text) IN (SELECT hash_sha256 FROM meta WHERE group_id = 0) AS found FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 9 = 0)"))
def existence_check(spark, d):
    m = meta(spark, d)
    return P.exists_in(m.where("id % 9 = 0").select("hash_sha256").distinct(), m.where("group_id = 0"))


@query(_m("SELECT id FROM meta WHERE status IN ('uploaded','failed','running','ocr_required','skipped') AND user_id = 3"))
def rollback_candidates(spark, d):
    return meta(spark, d).where(P.can_roll_back() & P.owned(3, [2])).select("id")


@query(_m("SELECT id, group_id FROM meta WHERE hash_sha256 = (SELECT hash_sha256 FROM meta WHERE id = 11)"))
def find_across_groups(spark, d):
    m = meta(spark, d)
    return m.join(m.where("id = 11").select("hash_sha256"), "hash_sha256", "left_semi").select("id", "group_id")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text)) > 0 AND length(text) <= CASE lang WHEN 'en' THEN 3000 WHEN 'fr' THEN 500 ELSE 50000 END")
def text_length_limit(spark, d):
    limits = spark.createDataFrame([("en", 3000), ("fr", 500)], "lang string, most int")
    rows = T.load(spark, d, "documents").join(J.small(limits), "lang", "left")
    return rows.where(P.text_fits(F.coalesce("most", F.lit(50_000)))).select("doc_id", F.length("text").cast("bigint").alias("n"))


# ---- joins ----------------------------------------------------------------------------------------------------------


@query(_m("""SELECT r.hash_sha256, CASE WHEN m.ok IS NULL THEN 'not_found' WHEN NOT m.ok THEN 'wrong_status' END AS reason
 FROM (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN sha256('x' || id) ELSE hash_sha256 END AS hash_sha256 FROM meta WHERE id % 3 = 0) r
 LEFT JOIN (SELECT hash_sha256, bool_or(status = 'registered') AS ok FROM meta WHERE list_has_any(role_ids, [1, 3]) GROUP BY 1) m USING (hash_sha256)"""))  # fmt: skip
def validate_documents(spark, d):
    m = meta(spark, d)
    other = F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256)
    asked = m.where("id % 3 = 0").select(F.when(F.col("id") % 4 == 0, other).otherwise(F.col("hash_sha256")).alias("hash_sha256"))
    return J.validate(asked, m.where(P.has_role(ROLES)), ["registered"])


@query(_m("""SELECT hash_sha256, bool_or(list_has_any(role_ids, [1, 3])) AS authorised FROM meta WHERE hash_sha256 IN (SELECT hash_sha256 FROM meta WHERE id % 10 = 3) GROUP BY 1"""))
def split_authorised(spark, d):
    m = meta(spark, d)
    yes, no = J.split_authorised(m.where("id % 10 = 3"), m, ROLES)
    return yes.withColumn("authorised", F.lit(True)).union(no.withColumn("authorised", F.lit(False)))


_MODELS = [("small", "acme", 2e-8), ("large", "acme", 1.3e-7), ("other", "zen", 5e-8)]


@query(_m("SELECT id, model_name, round(token * price, 9) AS model_cost FROM meta, (VALUES ('small', 2e-8), ('large', 1.3e-7), ('other', 5e-8)) AS p(model_name, price)"))
def price_matrix(spark, d):
    models = spark.createDataFrame(_MODELS, "model_name string, provider string, input_cost_per_token double")
    return J.price_matrix(meta(spark, d), models).select("id", "model_name", F.round("model_cost", 9).alias("model_cost"))


@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 2e-8 WHEN 1 THEN 1.3e-7 WHEN 2 THEN 1.3e-7 WHEN 3 THEN 5e-8 END AS price FROM documents""")
def model_price_lookup(spark, d):
    """Exact names; provider and part of a name; too much of a name, another provider, a longer path, an unknown name."""
    models = spark.createDataFrame([("small", "acme", 2e-8), ("acme-large", "acme", 1.3e-7), ("large-old", "acme", 9e-8), ("zen/o", "zen", 5e-8)], "model_name string, provider string, input_cost_per_token double")
    name = F.element_at(F.array(*map(F.lit, ("small", "acme/large", "acme/larg", "zen/zen/o", "zen/large", "x/acme/large/1", "none"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return S.with_price(T.load(spark, d, "documents").select("doc_id", name.alias("model")), models).select("doc_id", "price")


@query(_m("SELECT id, c_name AS full_name FROM meta LEFT JOIN customer ON user_id = c_custkey"))
def user_names(spark, d):
    users = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"))
    return J.with_names(meta(spark, d), users).select("id", "full_name")


@query(_m("""SELECT t.id, coalesce(CASE WHEN s.id % 2 = 0 THEN s.id * 10 END, CASE WHEN t.id % 5 = 0 THEN -1 END) AS ext_id FROM meta t LEFT JOIN (SELECT id FROM meta WHERE id % 2 = 0) s USING (id)"""))
def key_backfill(spark, d):
    m = meta(spark, d)
    target = m.select("id", F.when(F.col("id") % 5 == 0, F.lit(-1).cast("bigint")).alias("ext_id"))
    return J.backfill(target, m.where("id % 2 = 0").select("id", (F.col("id") * 10).alias("ext_id")), ["id"], "ext_id")


@query(_m("SELECT count(*) AS matched, count(*) FILTER (id % 10 <> 0) AS changed FROM meta WHERE id % 2 = 0"))
def key_backfill_dry_run(spark, d):
    m = meta(spark, d)
    target = m.select("id", F.when(F.col("id") % 5 == 0, F.col("id") * 10).alias("ext_id"))
    return J.backfill_count(target, m.where("id % 2 = 0").select("id", (F.col("id") * 10).alias("ext_id")), ["id"], "ext_id")


@query(_m("""SELECT min(id) AS id, group_id, hash_sha256 FROM meta WHERE id % 2 = 1 GROUP BY group_id, hash_sha256
 HAVING NOT EXISTS (SELECT 1 FROM meta o WHERE o.id % 2 = 0 AND o.group_id = meta.group_id AND o.hash_sha256 = meta.hash_sha256)"""))  # fmt: skip
def new_documents(spark, d):
    m = meta(spark, d)
    return J.not_registered(m.where("id % 2 = 1"), m.where("id % 2 = 0")).select("id", "group_id", "hash_sha256")


@query(_m("SELECT id, id % 6 <> 0 OR id % 4 <> 0 AS is_relevant, CASE WHEN id % 4 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS relevance FROM meta"))
def chunk_verdicts(spark, d):
    m = meta(spark, d).select("id")
    verdicts = m.where("id % 4 = 0").select("id", (F.col("id") % 6 != 0).alias("is_relevant"), F.lit(0.25).alias("relevance"))
    return J.with_verdicts(m, verdicts, ["id"])


_TREE = "WITH RECURSIVE c AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_nationkey >= 4 THEN n_nationkey::BIGINT // 4 END AS parent_id FROM nation)"


def _tree(spark, d):
    k = F.col("n_nationkey").cast("bigint")
    return T.load(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("name"), F.when(k >= 4, F.floor(k / 4)).alias("parent_id"))


@query(f"""{_TREE}, t AS (SELECT id, name, parent_id, 0 AS depth, name AS path FROM c WHERE parent_id IS NULL
 UNION ALL SELECT c.id, c.name, c.parent_id, depth + 1, t.path || '/' || c.name FROM c JOIN t ON c.parent_id = t.id) SELECT id, depth, path FROM t""")  # fmt: skip
def category_paths(spark, d):
    return J.category_paths(_tree(spark, d)).select("id", "depth", "path").orderBy("depth", "path")


@query(f"{_TREE} SELECT c.id, coalesce((SELECT string_agg(k.name, ',' ORDER BY k.name) FROM c k WHERE k.parent_id = c.id), '') AS children FROM c")
def category_children(spark, d):
    return J.with_children(_tree(spark, d)).select("id", F.array_join("children.name", ",").alias("children"))


@query(_m("SELECT hash_sha256, count(*) AS n, true AS valid FROM meta GROUP BY 1 HAVING count(*) > 1"))
def repeated_hashes(spark, d):
    return J.repeated_keys(meta(spark, d))


@query(_m("SELECT DISTINCT id * 2 AS id FROM meta WHERE id * 2 NOT IN (SELECT id FROM meta)"))
def missing_ids(spark, d):
    m = meta(spark, d)
    return T.missing_keys(m.select((F.col("id") * 2).alias("id")), m, "id")


@query(_m("SELECT id FROM meta WHERE list_has_any(role_ids, [user_id, user_id + 1])"))
def role_overlap(spark, d):
    return meta(spark, d).where(F.arrays_overlap("role_ids", F.array("user_id", F.col("user_id") + 1))).select("id")


@query(_m("SELECT id, array_to_string(list_sort(list_distinct(list_concat(role_ids, [user_id, 3]))), ',') AS ids FROM meta"))
def keyword_union(spark, d):
    return meta(spark, d).select("id", F.array_join(F.array_sort(S.ordered_union("role_ids", F.array("user_id", F.lit(3).cast("bigint")))), ",").alias("ids"))


# ---- aggregates -----------------------------------------------------------------------------------------------------

_DAY = "CAST(to_timestamp(end_date) AT TIME ZONE 'UTC' + INTERVAL 9 HOUR AS DATE)"
_DAILY = f"""daily AS (SELECT c.date, coalesce(cost, 0) AS cost, coalesce(file_size, 0) AS file_size, coalesce(documents, 0) AS documents
 FROM (SELECT CAST(range AS DATE) AS date FROM range(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) c
 LEFT JOIN (SELECT {_DAY} AS date, sum(cost + summary_cost) AS cost, CAST(sum(file_size) AS BIGINT) AS file_size, count(*) AS documents FROM meta WHERE user_id = 2 GROUP BY 1) g USING (date))"""


@query(f"WITH {META}, {_DAILY} SELECT CAST(date AS VARCHAR) AS date, round(cost, 6) AS cost, file_size, documents FROM daily")
def daily_cost(spark, d):
    out = A.daily_cost(meta(spark, d), "2023-12-31", "2024-02-02", user_id=2)
    return out.select(F.col("date").cast("string").alias("date"), F.round("cost", 6).alias("cost"), "file_size", "documents")


@query(f"""WITH {META}, {_DAILY} SELECT round(sum(cost), 6) AS total_cost, CAST(sum(file_size) AS BIGINT) AS total_size, CAST(sum(documents) AS BIGINT) AS total_documents, count(*) AS days,
 round(sum(cost) / count(*), 6) AS avg_cost, CAST(floor(sum(file_size) / count(*)) AS BIGINT) AS avg_size, round(sum(documents) / count(*), 2) AS avg_documents FROM daily""")  # fmt: skip
def cost_summary(spark, d):
    s = A.period_summary(A.daily_cost(meta(spark, d), "2023-12-31", "2024-02-02", user_id=2))
    return s.withColumns({"total_cost": F.round("total_cost", 6), "avg_cost": F.round("avg_cost", 6)})


@query(_m(f"SELECT category, count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS file_size, {_STATS} FROM meta GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0, 0, 0, 0"))
def category_statistics(spark, d):
    m = meta(spark, d)
    names = m.select(F.col("category").alias("name")).distinct().union(spark.range(1).select(F.lit("none")))
    return A.category_statistics(m, names)


@query(_m(f"SELECT count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS file_size, {_STATS} FROM meta"))
def documents_summary(spark, d):
    return A.documents_summary(meta(spark, d))


@query(_m(f"SELECT count(*) AS n FROM meta WHERE {_ROLE_SQL} AND expiration_date > {NOW} AND contains(category, 'src1')"))
def visible_count(spark, d):
    return meta(spark, d).where(P.all_of(P.has_role(ROLES), P.unexpired(NOW, 2), P.contains("category", "src1"))).agg(F.count("*").alias("n"))


@query(_m("SELECT group_id, count(*) AS row_count, 'meta' AS db_type FROM meta GROUP BY 1 UNION ALL SELECT vec_id % 3, count(*), 'vector' FROM embeddings GROUP BY 1"))
def table_catalog(spark, d):
    vectors = T.load(spark, d, "embeddings").select((F.col("vec_id") % 3).alias("group_id"))
    return T.catalog_counts({"meta": meta(spark, d), "vector": vectors})


@query(_m("SELECT DISTINCT group_id, CASE WHEN group_id = 1 THEN 'unknown' ELSE 'meta' END AS db_type, CASE WHEN group_id <> 1 THEN group_id END AS parsed FROM meta"))
def table_names(spark, d):
    name = F.when(F.col("group_id") == 1, "OTHER").otherwise(F.concat(F.lit("TB_"), F.col("group_id").cast("string"), F.lit("_meta")))
    group, kind = T.name_parts("name")
    return meta(spark, d).select("group_id", name.alias("name")).distinct().select("group_id", kind.alias("db_type"), group.alias("parsed"))


@query(_m("SELECT id, start_date FROM meta WHERE group_id = 1 AND hash_sha256 NOT IN (SELECT hash_sha256 FROM meta WHERE id % 7 = 0)"))
def delete_by_keys(spark, d):
    m = meta(spark, d)
    return T.delete_keys(m.where("group_id = 1"), m.where("id % 7 = 0").select("hash_sha256").distinct()).select("id", "start_date")


@query(_m("SELECT id FROM meta WHERE NOT (status = 'failed' AND file_size < 3000)"))
def delete_by_predicate(spark, d):
    return T.delete_where(meta(spark, d), "status = 'failed' and file_size < 3000").select("id")


@query(_m("SELECT count(*) AS affected FROM meta WHERE status = 'failed'"))
def delete_preview(spark, d):
    return A.delete_preview(meta(spark, d), "status = 'failed'")[0]


@query(_m("SELECT id, title FROM meta WHERE status = 'failed' ORDER BY id LIMIT 10"))
def delete_preview_rows(spark, d):
    return A.delete_preview(meta(spark, d), "status = 'failed'")[1].select("id", "title")


@query(_m("SELECT 'meta' AS \"table\", count(*) AS deleted FROM meta WHERE id % 6 = 0 UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE vec_id % 6 = 0 AND vec_id IN (SELECT id FROM meta)"))
def delete_counts(spark, d):
    m = meta(spark, d)
    return T.affected({"meta": m.select("id"), "vector": T.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"))}, m.where("id % 6 = 0").select("id"))


@query(_m("SELECT id, CASE WHEN id % 5 = 0 THEN 'new_' || id ELSE title END AS title FROM meta UNION ALL SELECT -1 - id, 'added' FROM meta WHERE id % 100 = 0"))
def upsert_rows(spark, d):
    m = meta(spark, d).select("id", "title")
    new = m.where("id % 5 = 0").select("id", F.concat(F.lit("new_"), F.col("id").cast("string")).alias("title"))
    return T.upsert(m, new.union(m.where("id % 100 = 0").select(-1 - F.col("id"), F.lit("added"))), ["id"])


def _stored(spark, d) -> tuple[str, DataFrame]:
    """The document table written in a folder for each category, and its rows."""
    path = f"{T.shared_folder(spark)}/{uuid.uuid4().hex}"
    m = meta(spark, d).select("id", "title", "category")
    m.write.partitionBy("category").parquet(path)
    return path, m


_SOME = "(SELECT min(category) FROM meta)"


@query(_m(f"SELECT id, CASE WHEN id % 5 = 0 AND category = {_SOME} THEN 'new_' || id ELSE title END AS title, category FROM meta UNION ALL SELECT -1 - id, 'added', 'fresh' FROM meta WHERE id % 100 = 0"))
def upsert_in_place(spark, d):
    """Only the folders of the changed rows' categories are rewritten; one category is new."""
    path, m = _stored(spark, d)
    some = m.agg(F.min("category").alias("category"))
    changed = m.where("id % 5 = 0").join(F.broadcast(some), "category", "left_semi").select("id", F.concat(F.lit("new_"), F.col("id").cast("string")).alias("title"), "category")
    T.upsert_into(spark, path, "category", changed.union(m.where("id % 100 = 0").select(-1 - F.col("id"), F.lit("added"), F.lit("fresh"))), ["id"])
    return T.scan(spark, path)


@query(_m(f"SELECT id, title, category FROM meta WHERE category <> {_SOME} AND NOT (category = (SELECT max(category) FROM meta) AND id % 3 = 0)"))
def delete_in_place(spark, d):
    """A category loses some rows, another one all of them and with them its folder."""
    path, m = _stored(spark, d)
    ends = F.broadcast(m.agg(F.min("category").alias("_a"), F.max("category").alias("_b")))  # one row
    gone = m.join(ends, F.lit(True)).where("category = _a or (category = _b and id % 3 = 0)").select("category", "id")
    T.delete_from(spark, path, "category", gone)
    return T.scan(spark, path)


@query(_m("SELECT id, CASE WHEN id % 5 = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 0 ELSE file_size END AS file_size FROM meta"))
def patch_rows(spark, d):
    m = meta(spark, d).select("id", "status", "file_size")
    return T.patch(m, m.where("id % 5 = 0").select("id", F.lit("skipped").alias("status"), F.when(F.col("id") % 10 == 0, F.lit(0).cast("bigint")).alias("file_size")), ["id"])


# ---- rankings and listings ------------------------------------------------------------------------------------------


@query(_m("SELECT category, id, start_date, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY start_date DESC, id) AS rank FROM meta) WHERE rank <= 3"))
def recent_by_category(spark, d):
    return W.recent_documents(meta(spark, d)).select("category", "id", "start_date", F.col("rank").cast("bigint").alias("rank"))


@query(_m("SELECT id, start_date FROM meta ORDER BY start_date DESC, id LIMIT 3"))
def recent_overall(spark, d):
    return W.recent_documents(meta(spark, d), by=None).select("id", "start_date")


@query(_m("SELECT id, (row_number() OVER (PARTITION BY group_id ORDER BY id) - 1) // 500 AS batch FROM meta"))
def batch_numbers(spark, d):
    return W.batch_numbers(meta(spark, d), ["group_id"], ["id"], 500).select("id", "batch")


@query(_m("SELECT id, file_size FROM meta ORDER BY file_size DESC, id LIMIT 25 OFFSET 50"))
def sorted_page(spark, d):
    return W.page_of(meta(spark, d), W.sort_columns("file_size", "desc", ("file_size", "start_date"), "start_date"), 3, 25).select("id", "file_size")


@query(_m("SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages, 3 < ceil(count(*) / 25) AS has_next, true AS has_prev FROM meta"))
def page_information(spark, d):
    return meta(spark, d).agg(F.count("*").alias("t")).select(*W.page_info(F.col("t"), 3, 25))


@query(_m("SELECT id, category, CASE WHEN category = lag(category) OVER (PARTITION BY group_id ORDER BY id) THEN '' ELSE category END AS shown FROM meta"))
def blank_repeats(spark, d):
    rows = meta(spark, d).select("id", "group_id", "category", F.col("category").alias("shown"))
    return W.blank_repeats(rows, ["group_id"], "id", ["shown"]).select("id", "category", "shown")


@query(_m("SELECT hash_sha256, id, title FROM (SELECT *, row_number() OVER (PARTITION BY hash_sha256 ORDER BY file_size DESC, id) AS r FROM meta) WHERE r = 1"))
def first_per_hash(spark, d):
    return W.first_per_text(meta(spark, d), ["hash_sha256"], [F.desc("file_size"), "id"]).select("hash_sha256", "id", "title")


@query(_m("SELECT DISTINCT hash_sha256 FROM meta WHERE id % 4 <> 3"))
def scheduled_documents(spark, d):
    m = meta(spark, d)
    plans = m.groupBy((F.col("id") % 4).alias("s"), F.expr("id div 400").alias("_p")).agg(F.collect_list("hash_sha256").alias("document_hashes")).select("document_hashes", (F.col("s") != 3).alias("is_active"), F.lit(None).cast("bigint").alias("deleted_at"))
    return A.running_documents(plans)
