"""Joins of the document jobs: validation, backfill, zero-filled statistics, category trees."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import has_role
from ..sources.tables import shared_folder

#: Dimensions joined by broadcast must stay under this many rows; larger ones are joined by key.
MOST_BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def validate(requested: DataFrame, visible: DataFrame, allowed: Iterable[str], key: str = "hash_sha256") -> DataFrame:
    """requested keys with reason: null if a visible row has an allowed status, else 'not_found' or 'wrong_status'."""
    best = visible.groupBy(key).agg(F.max(F.col("status").isin(*allowed)).alias("_ok"))
    reason = F.when(F.col("_ok").isNull(), "not_found").when(~F.col("_ok"), "wrong_status")
    return requested.select(key).distinct().join(best, key, "left").select(key, reason.alias("reason"))


def split_authorised(requested: DataFrame, meta: DataFrame, roles: Iterable[int], key: str = "hash_sha256") -> tuple[DataFrame, DataFrame]:
    """(authorised, unauthorised) keys; keys that no row has are unauthorised."""
    mine = meta.where(has_role(roles)).select(key)
    keys = requested.select(key).distinct()
    return keys.join(mine, key, "left_semi"), keys.join(mine, key, "left_anti")


def price_matrix(docs: DataFrame, models: DataFrame) -> DataFrame:
    """Every model's cost for every document: models is a price list, checked to be small."""
    n = models.limit(1_001).count()
    if n > 1_000:
        raise ValueError("the price list has more than 1000 models")
    return docs.crossJoin(F.broadcast(models)).withColumn("model_cost", F.col("token") * F.col("input_cost_per_token"))


def with_names(rows: DataFrame, users: DataFrame, default: str | None = None) -> DataFrame:
    """rows with full_name by user_id; an unknown user has the default."""
    return rows.join(small(users.select("user_id", "full_name")), "user_id", "left").withColumn("full_name", F.coalesce("full_name", F.lit(default)))


def backfill(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """target with the column filled from source where the key matches (target's own value stays where it does not)."""
    return target.join(source.select(*keys, F.col(column).alias("_fill")), keys, "left").withColumn(column, F.coalesce("_fill", column)).drop("_fill")


def backfill_count(target: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(matched, changed): the dry run of backfill."""
    both = target.select(*keys, F.col(column).alias("_old")).join(source.select(*keys, F.col(column).alias("_new")), keys)
    return both.agg(F.count("*").alias("matched"), F.count_if(~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))


def not_registered(new: DataFrame, registered: DataFrame, roles: Iterable[int] | None = None) -> DataFrame:
    """Rows of new whose content no visible row of their group has; one row (the least id) for equal content in the batch."""
    seen = registered.where(has_role(roles)) if roles is not None else registered
    first = new.groupBy("group_id", "hash_sha256").agg(F.min("id").alias("id"))
    fresh = first.join(seen.select("group_id", "hash_sha256"), ["group_id", "hash_sha256"], "left_anti")
    return new.join(fresh.select("id"), "id", "left_semi")


def with_verdicts(chunks: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with an external verdict; a missing one means relevant with score 0.5."""
    joined = chunks.join(verdicts.select(*keys, "is_relevant", "relevance"), keys, "left")
    return joined.withColumn("is_relevant", F.coalesce("is_relevant", F.lit(True))).withColumn("relevance", F.coalesce("relevance", F.lit(0.5)))


def with_persona(rows: DataFrame, personas: DataFrame) -> DataFrame:
    """rows with the non-blank prompt of their persona (null if there is none)."""
    known = personas.where(F.length(F.trim("prompt")) > 0).select("persona_id", "prompt")
    return rows.join(small(known), "persona_id", "left")


def with_document(hits: DataFrame, documents: DataFrame, order: list) -> DataFrame:
    """Search hits (query_id, hash_sha256, parsed_text, ...) with the title and file name of their document.

    documents: (query_id, hash_sha256, title, filename) of the documents that a query may show; hits of others go. Of
    equal texts of a query the first in the given order stays.
    """
    from .windows import first_per_text

    return first_per_text(hits.drop("title", "filename").join(documents, ["query_id", "hash_sha256"]), ["query_id", "parsed_text"], order)


def source_hash(items: DataFrame, titles: DataFrame, stem: Column) -> DataFrame:
    """Evaluation items with the hash of the document whose unique title is their source's stem."""
    return items.withColumn("_t", stem).join(titles.select(F.col("title").alias("_t"), "hash_sha256"), "_t", "left").drop("_t")


def evaluation_rows(items: DataFrame, results: DataFrame, scores: DataFrame) -> DataFrame:
    """Items with their retrieved chunks in rank order and their scores."""
    got = results.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "page_number"))).alias("retrieved_chunks"), F.count("*").alias("num_results"))
    return items.join(got, "item_id", "left").join(scores, "item_id").withColumn("num_results", F.coalesce("num_results", F.lit(0)))


def category_paths(categories: DataFrame) -> DataFrame:
    """categories (id, name, parent_id) with depth (roots 0) and path, by one join a level until no row is left.

    Rows on a cycle have no root above them and no path. A level's rows are cut from their lineage every eighth level.
    """
    done = categories.where("parent_id is null").select("id", "name", "parent_id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    edge = done
    for k in count(1):
        up = edge.select(F.col("id").alias("parent_id"), F.col("path").alias("_p"))
        edge = categories.select("id", "name", "parent_id").join(up, "parent_id").select("id", "name", "parent_id", F.lit(k).alias("depth"), F.concat_ws("/", "_p", "name").alias("path"))
        if k % 8 == 0:
            shared_folder(categories.sparkSession)
            edge = edge.checkpoint()
        if edge.isEmpty():
            return done
        done = done.union(edge)


def with_children(categories: DataFrame) -> DataFrame:
    """categories with their children by name, as an array of (id, name)."""
    kids = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("children"))
    return categories.join(kids, "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<name:string,id:bigint>>")))


def consistency(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(side, n): chunks that only one of the two stores has, by (hash_sha256, chunk_index)."""
    keys = ["hash_sha256", "chunk_index"]
    a = chunks.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = postings.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "chunks_only").when(F.col("_a").isNull(), "postings_only").otherwise("both")
    return a.join(b, keys, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def repeated_keys(requested: DataFrame, key: str = "hash_sha256", length: int = 64) -> DataFrame:
    """(key, n, valid): keys that repeat or are not of the given length."""
    return requested.groupBy(key).agg(F.count("*").alias("n")).withColumn("valid", F.length(key) == length).where((F.col("n") > 1) | ~F.col("valid"))
