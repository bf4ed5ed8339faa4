"""Upload events: decoding with defaults, dead letters, removal of duplicates, and the running job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso_epoch, routing_category, stem, suffix
from ..schemas import UPLOAD_EVENT


def decode(events: DataFrame, body: str = "value") -> DataFrame:
    """One row an event with all defaults filled; valid says whether it has a task, a path and a user, and its body is JSON."""
    e = F.from_json(F.col(body).cast("string"), UPLOAD_EVENT)
    d = events.withColumn("_e", e).withColumn("_m", F.col("_e.metadata")).withColumn("_p", F.col("_e.user_info.passport_data"))
    path = F.col("_e.file_path")
    name = F.coalesce("_m.filename", F.element_at(F.split(path, "/"), -1))
    return d.select(
        F.col(body).alias("body"), F.col("_e.task_id").alias("task_id"), path.alias("file_path"), F.coalesce("_e.file_size", F.lit(0)).alias("file_size"),
        F.coalesce("_m.pipeline_separation", F.lit(True)).alias("pipeline_separation"), F.coalesce("_m.title", stem(path)).alias("title"), name.alias("filename"),
        F.coalesce("_m.file_type", suffix(path)).alias("file_type"), F.coalesce("_m.category", routing_category("_m.routing_analysis.routing_key")).alias("category"),
        iso_epoch("_m.expiration_date").alias("expiration_date"), F.coalesce("_m.chunk_size", F.lit(500)).alias("chunk_size"), F.coalesce("_m.chunk_overlap", F.lit(50)).alias("chunk_overlap"),
        F.coalesce("_m.enable_pii_anonymization", F.lit(False)).alias("anonymize"), F.coalesce("_m.pii_strategy", F.lit("mask")).alias("pii_strategy"), F.col("_m.pii_types").alias("pii_types"),
        F.col("_m.persona_id").alias("persona_id"), F.col("_m.filter_score").alias("filter_score"), F.coalesce("_m.urls.stream_url", path).alias("stream_url"),
        F.col("_p.user_id").alias("user_id"), F.get("_p.groups", F.lit(0)).alias("group_id"), F.coalesce("_p.total_roles", F.array().cast("array<bigint>")).alias("role_ids"),
        F.coalesce(F.col("_e.task_id").isNotNull() & path.isNotNull() & F.col("_p.user_id").isNotNull(), F.lit(False)).alias("valid"),
    )


def branches(decoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(register only, full pipeline, dead letters)."""
    good = decoded.where("valid")
    return good.where("pipeline_separation"), good.where("not pipeline_separation"), decoded.where("not valid").select("body")


def without_duplicates(stream: DataFrame, registered: DataFrame, time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Events whose content neither an earlier one within the watermark nor the registered table (group_id, hash_sha256) has."""
    keys = ["group_id", "hash_sha256"]
    once = stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
    return once.join(registered.select(*keys).distinct(), keys, "left_anti")


def start(events: DataFrame, register: Callable[[DataFrame, str], None], dead_letters: str, checkpoint: str):
    """Starts the job over what is there: each micro-batch is decoded once, its broken bodies go to dead_letters, the rest
    to register(batch, run_id), with the batch id as run_id so that a batch that runs again can undo itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = decode(batch).persist()
        try:
            rows.where("not valid").select("body").write.mode("overwrite").parquet(f"{dead_letters}/batch_id={batch_id}")
            register(rows.where("valid"), f"run-{batch_id}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
