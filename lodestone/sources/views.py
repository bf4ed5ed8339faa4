"""Document, chunk, log and query views that are derived from the plain tables, lazily and column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STATUSES
from .tables import load

NOW = 1_718_000_000


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the columns of schemas.META."""
    d = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    title = F.concat(F.lit("doc_"), i.cast("string"))
    start = F.lit(1_704_067_200) + (i * 3571) % 2_592_000
    return d.select(
        i.alias("id"), (i % 3).alias("group_id"), (1 + i % 7).alias("user_id"), F.col("source").alias("category"), title.alias("title"),
        F.concat(title, F.lit(".txt")).alias("filename"), F.sha2("text", 256).alias("hash_sha256"), F.col("n_chars").alias("file_size"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (i % 7 + 1).cast("int")).alias("status"), F.array(i % 5, i % 11).alias("role_ids"),
        start.alias("start_date"), (start + i % 900).alias("end_date"), (F.lit(1_704_067_200) + (i % 400) * 86400).alias("expiration_date"),
        F.floor(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))) / 2).alias("token"),
        (F.col("n_chars") * 1e-7).alias("cost"), (F.col("n_chars") * 2e-8).alias("summary_cost"),
    )


def action_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows from the events."""
    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (i % 4 + 1).cast("int"))
    endpoint = F.element_at(F.array(*map(F.lit, ("/v1/documents/12", "/v1/embeddings/retrieval", "/health", "/v1/costs/statistics", "/docs"))), (i % 5 + 1).cast("int"))
    code = F.when(F.col("event_type") == "error", 500).when(i % 13 == 0, 404).otherwise(200)
    return e.select(
        i.alias("id"), "user_id", F.col("event_type").alias("action_type"), endpoint.alias("endpoint"), method.alias("http_method"), code.alias("status_code"),
        F.when(code.between(200, 399), "SUCCESS").otherwise("FAILED").alias("success"), (i % 1000).alias("processing_time_ms"), F.col("props").alias("action_details"),
        F.concat(F.lit("s"), (i % 50).cast("string")).alias("session_id"), F.col("ts").alias("created_at"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events from the events."""
    e = load(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("in_progress")
    return e.select(
        (i % 200).cast("string").alias("task_id"), "user_id", F.sha2((i % 200).cast("string"), 256).alias("hash_sha256"),
        F.when(i % 9 == 0, "").otherwise(F.concat(F.lit("c"), (i % 4).cast("string"))).alias("category"), F.col("event_type").alias("stage"), status.alias("status"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), i.alias("event_id"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, embedding): every 20th vector asks."""
    return load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the benchmark items ask, with their whole texts."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
