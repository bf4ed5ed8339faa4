"""Whole searches for a table of queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import has_role
from ..operators import hybrid, keyword, vectors
from ..operators.aggregates import search_statistics
from ..operators.joins import with_document
from ..operators.windows import normalised_keyword


def dense_top_k_statistics(queries: DataFrame, vecs: DataFrame, k: int = 10, name: str = "label") -> DataFrame:
    """Exact top-k of each query and the statistics of its results, a column of the vectors in the place of the file name."""
    hits = vectors.dense_top_k(queries, vecs, k)
    named = hits.join(vecs.select(F.col("vec_id").alias("id"), F.col(name).cast("string").alias("filename")), "id")
    return search_statistics(named, queries)


def two_stage_search(queries: DataFrame, meta: DataFrame, chunks: DataFrame, limit: int, roles: Iterable[int], threshold: float = 0.7) -> DataFrame:
    """(query_id, id, hash_sha256, parsed_text, score, rank, title, filename): chunks of the documents that a first search finds.

    meta: (id, hash_sha256, embedding, role_ids, title, filename); chunks: (id, hash_sha256, parsed_text, embedding). Of
    the visible documents min(2 * limit, 50) are taken for each query, those at the threshold or above stay, and the
    best `limit` of their chunks are shown, each text once.
    """
    seen = meta.where(has_role(roles))
    first = vectors.dense_top_k(queries, seen, hybrid.stage_one_limit(limit), id_col="id").where(F.col("score") >= threshold)
    found = first.select("query_id", "id").join(seen.select("id", "hash_sha256", "title", "filename"), "id").select("query_id", "hash_sha256", "title", "filename")
    pairs = hybrid.restrict(chunks.select("id", "hash_sha256"), found).select("query_id", "id")
    top = vectors.dense_top_k(queries, chunks, limit, id_col="id", within=pairs).select("query_id", "id", "score", "rank")
    return with_document(top.join(chunks.select("id", "hash_sha256", "parsed_text"), "id"), found, [F.desc(F.round("score", 12)), F.asc("id")])


def keyword_search(queries: DataFrame, docs: DataFrame, limit: int, now: int) -> DataFrame:
    """(query_id, doc_key, score, rank): BM25 over docs (doc_key, text, role_ids, expiration_date) for queries (query_id, query, role_ids).

    A query sees documents that share a role with it and have not expired; term statistics are those of all documents.
    """
    roles = queries.select("query_id", F.explode("role_ids").alias("mark"))
    shown = docs.withColumn("_roles", F.when(F.col("expiration_date") > now, F.col("role_ids")))
    return keyword.bm25_top_k(keyword.bm25_scores(keyword.query_terms(queries), shown, "doc_key", "text", k=limit, marks=("_roles", roles)), limit)


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, limit: int = 10, dense_weight: float = 0.7, keyword_weight: float = 0.3, threshold: float = 0.0, keyword_limit: int | None = None,
    documents: DataFrame | None = None,
) -> DataFrame:
    """(query_id, chunk_id, parsed_text, dense_score, keyword_score, score, rank) of queries (query_id, query, embedding).

    chunks: (chunk_id, hash_sha256, parsed_text, embedding). Dense and keyword results are fused on the text; of equal
    texts the chunk with the least id speaks. documents (query_id, hash_sha256) restricts both sides to a first stage's result.
    """
    pairs = None
    if documents is not None:
        pairs = hybrid.restrict(chunks.select(F.col("chunk_id").alias("id"), "hash_sha256"), documents).select("query_id", "id")
    dense = vectors.dense_top_k(queries, chunks, limit, id_col="chunk_id", within=pairs).select("query_id", F.col("id").alias("chunk_id"), F.col("score").alias("dense_score"))
    scores = keyword.bm25_scores(keyword.query_terms(queries), chunks, "chunk_id", "parsed_text", pairs.withColumnRenamed("id", "doc_key") if pairs is not None else None, k=keyword_limit or limit)
    top = keyword.bm25_top_k(scores, keyword_limit or limit)
    sparse = normalised_keyword(top).select("query_id", F.col("doc_key").alias("chunk_id"), F.col("norm").alias("keyword_score"))
    text = chunks.select("chunk_id", "parsed_text")

    def by_text(df: DataFrame, col: str) -> DataFrame:
        return df.join(text, "chunk_id").groupBy("query_id", "parsed_text").agg(F.max(col).alias(col), F.min("chunk_id").alias("chunk_id"))

    fused = hybrid.fuse(by_text(dense, "dense_score"), by_text(sparse, "keyword_score"), dense_weight, keyword_weight, info=("chunk_id",))
    return hybrid.finish(fused, threshold, limit).select("query_id", "chunk_id", "parsed_text", "dense_score", "keyword_score", "score", "rank")
