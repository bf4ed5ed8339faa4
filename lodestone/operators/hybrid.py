"""Hybrid search: two-stage dense search, keyword search, fusion, reranking; all queries of a table in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import score_at_least
from .windows import first_per_text

RRF_K = 60


def stage_one_limit(limit: int) -> int:
    return min(2 * limit, 50)


def restrict(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, ...) chunks of the documents that survived the first stage; documents: (query_id, hash_sha256)."""
    return chunks.join(documents.select("query_id", "hash_sha256").distinct(), "hash_sha256")


def fuse(dense: DataFrame, keyword: DataFrame, dense_weight: float = 0.7, keyword_weight: float = 0.3, key: str = "parsed_text", info: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two result lists on query and text; a missing score is 0, and the dense side's columns win.

    dense: (query_id, key, dense_score, ...); keyword: (query_id, key, keyword_score, ...); one row for a query and text.
    """
    d = dense.select("query_id", key, "dense_score", *[F.col(c).alias(f"_d_{c}") for c in info])
    s = keyword.select("query_id", key, "keyword_score", *[F.col(c).alias(f"_k_{c}") for c in info])
    both = d.join(s, ["query_id", key], "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dense_score", "keyword_score")})
    score = F.col("dense_score") * dense_weight + F.col("keyword_score") * keyword_weight
    return both.select("query_id", key, "dense_score", "keyword_score", score.alias("score"), *[F.coalesce(f"_d_{c}", f"_k_{c}").alias(c) for c in info])


def weighted(df: DataFrame, weight: float = 0.8, score: str = "score") -> DataFrame:
    return df.withColumn("rerank_score", F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * weight)


def reranked(results: DataFrame, scores: DataFrame | None, n: int, keys: list[str], tie: str) -> DataFrame:
    """The n best rows of each query by external scores (keys, rerank); without any for a query, by its own score."""
    joined = results.join(scores.select(*keys, "rerank"), keys, "left") if scores is not None else results.withColumn("rerank", F.lit(None).cast("double"))
    any_score = F.max("rerank").over(Window.partitionBy("query_id"))
    final = F.when(any_score.isNull(), F.col("score")).otherwise(F.col("rerank"))
    out = joined.withColumn("score", final).where("score is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
    return out.drop("rerank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rank_lists(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_key, weighted, rrf) of several lists (source, query_id, doc_key, score)."""
    w = Window.partitionBy("source", "query_id").orderBy(F.desc("score"), F.asc("doc_key"))
    weight = F.lit(0.8)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, value).otherwise(weight)
    ranked = lists.withColumn("_r", F.row_number().over(w)).withColumn("_w", weight)
    return ranked.groupBy("query_id", "doc_key").agg(F.sum(F.col("_w") * F.col("score")).alias("weighted"), F.sum(1.0 / (k + F.col("_r"))).alias("rrf"))


def finish(fused: DataFrame, threshold: float, limit: int, key: str = "parsed_text") -> DataFrame:
    """Threshold, one row for a text, the best `limit` rows of each query in order."""
    kept = first_per_text(fused.where(score_at_least(threshold)), ["query_id", key], [F.desc("score"), F.asc(key)])
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc(key))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def union_variants(variants: DataFrame, results: DataFrame, key: str = "parsed_text") -> DataFrame:
    """Results of rewritten queries under their original query: variants (variant_id, query_id), the best score for a text."""
    best = results.join(variants, results["query_id"] == variants["variant_id"]).select(variants["query_id"], F.col(key), F.col("score"))
    return best.groupBy("query_id", key).agg(F.max("score").alias("score"))
