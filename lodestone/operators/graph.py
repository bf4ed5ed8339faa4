"""Entity search and expansion over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A task of a hop gets about this many edges, however many there are.
EDGES_OF_TASK = 500_000


def entity_documents(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, hash_sha256, entity_name, score): documents of entity hits (query_id, entity_name, score); the best entity wins."""
    rows = hits.join(entities.select("entity_name", F.explode("source_hashes").alias("hash_sha256")), "entity_name")
    w = Window.partitionBy("query_id", "hash_sha256").orderBy(F.desc("score"), F.asc("entity_name"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("query_id", "hash_sha256", "entity_name", "score")


def expand(start: DataFrame, edges: DataFrame, max_hops: int = 2, relation: str | None = None) -> DataFrame:
    """(query_id, entity, hop, path): entities reachable from start (query_id, entity) in at most max_hops (0 to 2).

    Edges (source_entity, relation_type, target_entity) are followed both ways. An entity keeps its least hop and, among
    those, its least path. Each hop is one join, less the entities already visited. Edges are counted first and dealt to as
    many tasks as they need, and repeated ones are dropped there, so that a task's tables do not grow with them.
    """
    if not 0 <= max_hops <= 2:
        raise ValueError("max_hops is 0, 1 or 2")
    e = edges.where(F.col("relation_type") == relation) if relation else edges
    e = e.select(F.col("source_entity").alias("a"), F.col("target_entity").alias("b"))
    parts = max(start.sparkSession.sparkContext.defaultParallelism, -(-2 * e.count() // EDGES_OF_TASK)) if max_hops else 1
    e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition(parts, "a").dropDuplicates(["a", "b"])
    seen = start.select("query_id", "entity").distinct().select("query_id", "entity", F.lit(0).alias("hop"), F.array("entity").alias("path"))
    front = seen
    for h in range(1, max_hops + 1):
        step = front.join(e, F.col("entity") == F.col("a")).select("query_id", F.col("b").alias("entity"), F.concat("path", F.array("b")).alias("path"))
        best = step.repartition(parts, "query_id", "entity").groupBy("query_id", "entity").agg(F.min("path").alias("path"))
        front = best.join(seen, ["query_id", "entity"], "left_anti").select("query_id", "entity", F.lit(h).alias("hop"), "path")
        seen = seen.union(front)
    return seen


def merge_documents(found: DataFrame, graph: DataFrame) -> DataFrame:
    """Documents of the vector search and of the graph: the graph only adds its entity; its own rows have blank titles."""
    g = graph.select("query_id", "hash_sha256", F.col("entity_name").alias("graph_info"))
    m = found.join(g, ["query_id", "hash_sha256"], "full_outer")
    return m.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "filename")})
