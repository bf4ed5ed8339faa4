"""Vector, keyword and hybrid search for the queries of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, hybrid, keyword, vectors
from ..operators import windows as W
from ..operators.aggregates import file_statistics
from ..plans import search as plans
from ..sources.postings import Index
from ..sources.tables import load, shared_folder
from ..sources.views import NOW, meta, query_texts, query_vectors
from .base import query

_HITS = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q),
 h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 10)"""

_BM25 = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS dl FROM documents),
 n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
 sc AS (SELECT query_id, doc_id AS doc_key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM a JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), n GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_key) AS rank FROM sc) WHERE rank <= 10)"""

_NORM = """z AS (SELECT *, round(ln(1 + score), 9) AS s, count(*) OVER p AS n, max(round(ln(1 + score), 9)) OVER p AS mx, round(quantile_cont(round(ln(1 + score), 9), 0.2) OVER p, 9) AS q FROM top WINDOW p AS (PARTITION BY query_id)),
 y AS (SELECT *, CASE WHEN s > q THEN s END AS k FROM z),
 nm AS (SELECT query_id, doc_key, rank, CASE WHEN n = 1 THEN 1.0 WHEN n = 2 THEN s / mx WHEN k IS NULL THEN 0.0 WHEN min(k) OVER p = max(k) OVER p THEN 0.5
  ELSE (k - min(k) OVER p) / (max(k) OVER p - min(k) OVER p) END AS norm FROM y WINDOW p AS (PARTITION BY query_id))"""


@query(f"WITH {_HITS} SELECT query_id, id, rank, round(score, 6) AS score FROM h")
def dense_top_k(spark, d):
    return vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 10).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {_HITS} SELECT query_id, count(*) AS total, count(DISTINCT label) AS documents, round(avg(score), 4) AS avg_score, round(max(score), 4) AS max_score, round(min(score), 4) AS min_score
 FROM h GROUP BY 1""")  # fmt: skip
def dense_top_k_statistics(spark, d):
    return plans.dense_top_k_statistics(query_vectors(spark, d), load(spark, d, "embeddings"))


@query(f"""WITH {_HITS} SELECT query_id, CAST(label AS VARCHAR) AS filename, count(*) AS n, count(*) FILTER (score >= 0.825) AS high, count(*) FILTER (score >= 0.8 AND score < 0.825) AS medium,
 count(*) FILTER (score < 0.8) AS low FROM h GROUP BY 1, 2""")  # fmt: skip
def search_file_statistics(spark, d):
    e = load(spark, d, "embeddings")
    hits = vectors.dense_top_k(query_vectors(spark, d), e, 10).join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("filename")), "id")
    return file_statistics(hits, "query_id")


def _metric_sql(expr: str, desc: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS id, {expr} AS score FROM embeddings, q)
 SELECT query_id, id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) {desc}, id) AS rank FROM s) WHERE rank <= 5"""


@query(_metric_sql("list_dot_product(CAST(embedding AS DOUBLE[]), qv)", "DESC"))
def dense_top_k_inner_product(spark, d):
    return vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 5, "IP").select("query_id", "id", F.round("score", 5).alias("score"))


@query(_metric_sql("list_distance(CAST(embedding AS DOUBLE[]), qv)", "ASC"))
def dense_top_k_distance(spark, d):
    return vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 5, "L2").select("query_id", "id", F.round("score", 5).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
 s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS score FROM embeddings, q WHERE label = ql)
 SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 10""")  # fmt: skip
def dense_top_k_restricted(spark, d):
    e = load(spark, d, "embeddings")
    pairs = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    return vectors.dense_top_k(query_vectors(spark, d), e, 10, within=pairs).select("query_id", "id", F.round("score", 6).alias("score"))


def _clustered(spark, d, probes: int | None):
    e, path = load(spark, d, "embeddings"), f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    centroids = vectors.fit_clusters(e, 128)
    vectors.write_clusters(e, path, centroids)
    return vectors.stored_top_k(query_vectors(spark, d), path, 10, probes or vectors.probes_for(e, centroids))


@query()
def clustered_top_k(spark, d):
    """A stored cluster index, made and searched in as many clusters as its recall needs."""
    return _clustered(spark, d, None).select("query_id", "id", F.round("score", 12).alias("score"), "rank")


@query(f"WITH {_HITS} SELECT query_id, id, rank, round(score, 6) AS score FROM h")
def clustered_top_k_all(spark, d):
    """The same index with every cluster probed, which finds what the exact search finds."""
    return _clustered(spark, d, 128).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'null' WHEN vec_id % 5 = 1 THEN 'empty' ELSE 'dimension' END AS reason FROM embeddings WHERE vec_id % 5 < 3")
def invalid_vectors(spark, d):
    k = F.col("vec_id") % 5
    v = F.when(k == 1, F.array().cast("array<float>")).when(k == 2, F.slice("embedding", 1, 3)).when(k > 2, F.col("embedding"))
    return vectors.invalid_vectors(load(spark, d, "embeddings").select("vec_id", v.alias("embedding")), 64).select("vec_id", "reason")


@query("SELECT vec_id, CAST(0 AS DOUBLE) AS total, len(embedding) AS n FROM embeddings")
def zero_vectors(spark, d):
    z = vectors.zero_vector(64)
    return load(spark, d, "embeddings").select("vec_id", F.aggregate(z, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(z).cast("bigint").alias("n"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM b WHERE vec_id % 20 = 0),
 c AS (SELECT query_id, vec_id, list_dot_product(v, qv) AS common, list_sum(v) + list_sum(qv) - list_dot_product(v, qv) AS one FROM b, q)
 SELECT query_id, count(*) AS n, max(one - common) AS hamming, round(sum(CASE WHEN one = 0 THEN 0 ELSE 1 - common / one END), 6) AS jaccard FROM c GROUP BY 1""")  # fmt: skip
def binary_metrics(spark, d):
    """Bits of every 20th vector against those of all, in blocks of both."""
    b = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("bits"))
    out = vectors.bit_statistics(b.where("id % 20 = 0").withColumnRenamed("id", "query_id"), b)
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents)
 SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY 1""")  # fmt: skip
def keyword_index(spark, d):
    p = keyword.postings(load(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25(spark, d):
    return keyword.bm25_top_k(keyword.bm25_scores(keyword.query_terms(query_texts(spark, d)), load(spark, d, "documents"), "doc_id", "text", k=10), 10)


@query(f"WITH {_BM25} SELECT query_id, doc_key, rank, round(score, 6) AS score FROM top")
def bm25_top_k(spark, d):
    return _bm25(spark, d).select("query_id", "doc_key", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _stored_index(spark, d) -> Index:
    index = Index(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    index.change(load(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text"))
    return index


def _stored_top(index: Index, asked) -> DataFrame:
    return keyword.bm25_top_k(index.bm25(asked, 10), 10).select("query_id", "doc_key", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT query_id, doc_key, rank, round(score, 6) AS score FROM top")
def bm25_stored(spark, d):
    """The keyword index written in term buckets, and the search in the buckets that the queries ask for."""
    return _stored_top(_stored_index(spark, d), keyword.query_terms(query_texts(spark, d)))


_EDITED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Edited ' || substring(text, 1, 300) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1)"


@query(f"WITH {_BM25.replace('FROM documents', 'FROM ' + _EDITED)} SELECT query_id, doc_key, rank, round(score, 6) AS score FROM top")
def bm25_after_edits(spark, d):
    """The stored index after a delta that edits some documents and removes others."""
    index, docs = _stored_index(spark, d), load(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text")
    edited = docs.where("doc_key % 7 = 0").select("doc_key", F.concat(F.lit("Edited "), F.substring("text", 1, 300)).alias("text"))
    index.change(edited, docs.where("doc_key % 7 = 1"))
    return _stored_top(index, keyword.query_terms(query_texts(spark, d)))


@query(f"WITH {_BM25}, {_NORM} SELECT query_id, doc_key, round(norm, 6) AS norm FROM nm")
def keyword_normalised(spark, d):
    return W.normalised_keyword(_bm25(spark, d)).select("query_id", "doc_key", F.round("norm", 6).alias("norm"))


_CHUNKS = "ch AS (SELECT vec_id AS chunk_id, text AS parsed_text, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN documents ON vec_id = doc_id)"
_ASK = "b AS (SELECT item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS qv FROM benchmark JOIN embeddings e ON e.vec_id = item_id * 5)"


def _chunks(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("parsed_text"))
    return load(spark, d, "embeddings").join(docs, "vec_id").select(F.col("vec_id").alias("chunk_id"), F.sha2("parsed_text", 256).alias("hash_sha256"), "parsed_text", "embedding")


def _asked(spark, d):
    v = load(spark, d, "embeddings").select((F.col("vec_id") / 5).alias("query_id"), "embedding")
    return query_texts(spark, d).join(v, "query_id")


_KEY = _BM25.replace("FROM documents)", "FROM (SELECT chunk_id AS doc_id, parsed_text AS text FROM ch))").replace("FROM documents),", "FROM (SELECT chunk_id AS doc_id, parsed_text AS text FROM ch)),")

_FUSED = f"""{_CHUNKS}, {_ASK}, dn AS (SELECT query_id, chunk_id, score FROM (SELECT query_id, chunk_id, list_cosine_similarity(v, qv) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, qv), 12) DESC, chunk_id) AS rank FROM ch, b) WHERE rank <= 10),
 {_KEY}, {_NORM},
 d1 AS (SELECT query_id, parsed_text, max(score) AS ds, min(chunk_id) AS c FROM dn JOIN ch USING (chunk_id) GROUP BY 1, 2),
 k1 AS (SELECT query_id, parsed_text, max(norm) AS ks, min(doc_key) AS c FROM nm JOIN ch ON chunk_id = doc_key WHERE query_id IN (SELECT query_id FROM b) GROUP BY 1, 2),
 f AS (SELECT query_id, parsed_text, coalesce(ds, 0) AS ds, coalesce(ks, 0) AS ks, coalesce(ds, 0) * 0.7 + coalesce(ks, 0) * 0.3 AS score, coalesce(d1.c, k1.c) AS chunk_id
  FROM d1 FULL JOIN k1 USING (query_id, parsed_text))"""


@query(f"""WITH {_FUSED} SELECT query_id, chunk_id, round(ds, 6) AS dense_score, round(ks, 6) AS keyword_score, round(score, 6) AS score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, parsed_text) AS rank FROM f WHERE score >= 0.1) WHERE rank <= 10""")  # fmt: skip
def hybrid_search(spark, d):
    out = plans.hybrid_search(_asked(spark, d), _chunks(spark, d), 10, threshold=0.1)
    return out.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("dense_score", "keyword_score", "score")], F.col("rank").cast("bigint").alias("rank"))


_STAGED = """docs AS (SELECT sha256(text) AS hash_sha256, min(doc_id) AS doc, min(doc_id) % 3 AS role FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1),
 m AS (SELECT hash_sha256, doc, role, CAST(embedding AS DOUBLE[]) AS v FROM docs JOIN embeddings ON vec_id = doc), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
 one AS (SELECT query_id, hash_sha256, doc FROM (SELECT query_id, hash_sha256, doc, list_cosine_similarity(v, qv) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, qv), 12) DESC, doc) AS r FROM m, q WHERE role < 2) WHERE r <= 20 AND score >= 0.7),
 c AS (SELECT vec_id AS id, sha256(text) AS hash_sha256, text, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN documents ON vec_id = doc_id),
 two AS (SELECT query_id, id, hash_sha256, text, doc, list_cosine_similarity(v, qv) AS score FROM one JOIN c USING (hash_sha256) JOIN q USING (query_id)),
 top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS r FROM two),
 seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY round(score, 12) DESC, id) AS k FROM top WHERE r <= 10)"""


@query(f"WITH {_STAGED} SELECT query_id, id, round(score, 6) AS score, 't' || doc AS title FROM seen WHERE k = 1")
def two_stage_search(spark, d):
    """Documents first (twice the limit, at most 50, at 0.7 or more, under roles), then chunks of those; titles come from the document."""
    c = _chunks(spark, d).select(F.col("chunk_id").alias("id"), "hash_sha256", "parsed_text", "embedding")
    first = c.groupBy("hash_sha256").agg(F.min_by(F.struct("id", "embedding"), "id").alias("x")).select("hash_sha256", "x.*")
    meta = first.select("id", "hash_sha256", "embedding", F.array(F.col("id") % 3).alias("role_ids"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"))
    return plans.two_stage_search(query_vectors(spark, d), meta.withColumn("filename", F.col("title")), c, 10, (0, 1)).select("query_id", "id", F.round("score", 6).alias("score"), "title")


_SEEN = _BM25.replace(" top AS", " ok AS (SELECT query_id, doc_key, score FROM sc WHERE list_has_any([doc_key % 5, doc_key % 11], [query_id % 5, 3]) AND 1704067200 + (doc_key % 400) * 86400 > 1718000000),\n top AS").replace("AS rank FROM sc)", "AS rank FROM ok)")


@query(f"WITH {_SEEN} SELECT query_id, doc_key, rank, round(score, 6) AS score FROM top")
def bm25_visible(spark, d):
    """Keyword search under roles and expiry; the statistics are those of all documents."""
    asked = query_texts(spark, d).withColumn("role_ids", F.array(F.col("query_id") % 5, F.lit(3).cast("bigint")))
    docs = meta(spark, d).select(F.col("id").alias("doc_key"), "role_ids", "expiration_date").join(load(spark, d, "documents").select(F.col("doc_id").alias("doc_key"), "text"), "doc_key")
    top = plans.keyword_search(asked, docs, 10, NOW)
    return top.select("query_id", "doc_key", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_HITS} SELECT query_id, id, round(1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)), 9) AS rrf FROM h")
def reciprocal_rank(spark, d):
    hits = vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 10)
    return W.reciprocal_rank(hits, ["query_id"], "score", "id").select("query_id", "id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {_HITS} SELECT query_id, id, round(least(greatest(score, 0), 1) * 0.8, 6) AS rerank_score FROM h WHERE score >= 0.2")
def weighted_rerank(spark, d):
    from ..functions.predicates import score_at_least

    hits = vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 10).where(score_at_least(0.2))
    return hybrid.weighted(hits).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_HITS}, r AS (SELECT query_id, id, CASE WHEN query_id % 40 = 0 THEN (id * 37 % 101) / 101.0 ELSE score END AS s FROM h WHERE query_id % 40 <> 0 OR id % 2 = 0)
 SELECT query_id, id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM r) WHERE rank <= 3""")  # fmt: skip
def external_rerank(spark, d):
    hits = vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 10).select("query_id", "id", "score")
    scores = hits.where("query_id % 40 = 0 and id % 2 = 0").select("query_id", "id", ((F.col("id") * 37 % 101) / 101.0).alias("rerank"))
    return hybrid.reranked(hits, scores, 3, ["query_id", "id"], "id").select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_HITS}, l AS (SELECT 'a' AS source, query_id, id, score FROM h UNION ALL SELECT 'b', query_id, id, score * (id % 7) FROM h WHERE id % 2 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, id) AS k FROM l)
 SELECT query_id, id AS doc_key, round(sum(score * CASE source WHEN 'a' THEN 0.6 ELSE 0.8 END), 6) AS weighted, round(sum(1.0 / (60 + k)), 9) AS rrf FROM r GROUP BY 1, 2""")  # fmt: skip
def rank_lists(spark, d):
    hits = vectors.dense_top_k(query_vectors(spark, d), load(spark, d, "embeddings"), 10).select(F.lit("a").alias("source"), "query_id", F.col("id").alias("doc_key"), "score")
    both = hits.union(hits.where("doc_key % 2 = 0").select(F.lit("b"), "query_id", "doc_key", F.col("score") * (F.col("doc_key") % 7)))
    return hybrid.rank_lists(both, {"a": 0.6}).select("query_id", "doc_key", F.round("weighted", 6).alias("weighted"), F.round("rrf", 9).alias("rrf"))


@query(f"WITH {_BM25} SELECT query_id // 3 AS query_id, doc_key, round(max(score), 6) AS score FROM top GROUP BY 1, 2")
def multi_query_union(spark, d):
    variants = query_texts(spark, d).select(F.col("query_id").alias("variant_id"), F.expr("query_id div 3").alias("query_id"))
    return hybrid.union_variants(variants, _bm25(spark, d).select("query_id", "doc_key", "score"), "doc_key").select("query_id", "doc_key", F.round("score", 6).alias("score"))


_EDGES = """e0 AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"""


def _edges(spark, d):
    """Suppliers and their parts."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    return load(spark, d, "lineitem").select(name("s", "l_suppkey").alias("source_entity"), F.lit("supplies").alias("relation_type"), name("p", "l_partkey").alias("target_entity"))


@query(f"""WITH {_EDGES}, s AS (SELECT s_suppkey AS query_id, 's' || s_suppkey AS entity FROM supplier WHERE s_suppkey % 20 = 0),
 h1 AS (SELECT DISTINCT query_id, b AS entity FROM s JOIN e ON entity = a EXCEPT SELECT * FROM s),
 h2 AS (SELECT DISTINCT query_id, b AS entity FROM h1 JOIN e ON entity = a EXCEPT (SELECT * FROM s UNION SELECT * FROM h1))
 SELECT *, 0 AS hop FROM s UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""")  # fmt: skip
def graph_expansion(spark, d):
    """Every 20th supplier asks."""
    start = load(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"))
    return graph.expand(start, _edges(spark, d), 2).select("query_id", "entity", "hop")


@query("""WITH h AS (SELECT c_nationkey AS query_id, c_name AS entity_name, c_acctbal AS score, [c_custkey % 50, c_custkey % 31] AS hashes FROM customer),
 x AS (SELECT query_id, entity_name, score, 'h' || unnest(hashes) AS hash_sha256 FROM h)
 SELECT query_id, hash_sha256, entity_name FROM (SELECT *, row_number() OVER (PARTITION BY query_id, hash_sha256 ORDER BY score DESC, entity_name) AS r FROM x) WHERE r = 1""")  # fmt: skip
def entity_documents(spark, d):
    c = load(spark, d, "customer")
    name = lambda n: F.concat(F.lit("h"), (F.col("c_custkey") % n).cast("string"))
    entities = c.select(F.col("c_name").alias("entity_name"), F.array(name(50), name(31)).alias("source_hashes"))
    hits = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_name").alias("entity_name"), F.col("c_acctbal").cast("double").alias("score"))
    return graph.entity_documents(hits, entities).select("query_id", "hash_sha256", "entity_name")


@query("""WITH m AS (SELECT doc_id % 20 AS query_id, sha256(text) AS hash_sha256, min('t' || doc_id) AS title FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2),
 g AS (SELECT doc_id % 20 AS query_id, sha256(text) AS hash_sha256, min('e' || doc_id) AS graph_info FROM documents WHERE doc_id % 4 = 0 GROUP BY 1, 2)
 SELECT query_id, hash_sha256, coalesce(title, '') AS title, graph_info FROM m FULL JOIN g USING (query_id, hash_sha256)""")  # fmt: skip
def merge_graph_documents(spark, d):
    def side(k, mark, name):
        rows = load(spark, d, "documents").where(f"doc_id % {k} = 0")
        return rows.groupBy((F.col("doc_id") % 20).alias("query_id"), F.sha2("text", 256).alias("hash_sha256")).agg(F.min(F.concat(F.lit(mark), F.col("doc_id").cast("string"))).alias(name))

    found = side(3, "t", "title").withColumn("filename", F.col("title"))
    return graph.merge_documents(found, side(4, "e", "entity_name")).select("query_id", "hash_sha256", "title", "graph_info")
