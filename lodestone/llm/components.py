"""Connected components and exact links inside them, both spread over tasks whatever the size of a component."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): for each id on an edge, the smallest id that it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label (pointer jumping). Labels are
    checkpointed each round; a hub's edges meet its label in a join that Spark may split, and minima are combined
    before the shuffle. Null ids and self-loops make no edge. No edges: an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    e = cut(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = e.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        new = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "m").alias("mid"))
        up = labels.select(F.col("id").alias("mid"), F.col("component").alias("top"))
        labels = cut(new.join(up, "mid").select("id", "was", F.least("mid", "top").alias("component")))
        if not labels.where("was != component").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Copies of members (component, id, ...) so that any two of a component meet in one group (component, bi, bj).

    A component of at most `block` members is one group. A larger one is dealt into blocks by hash and each member goes
    to the pairs of its block with every block, so that a group holds about 2 * block rows at most, in any number of tasks.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    dealt = members.join(sizes, "component").withColumn("nb", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("id", "component"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other", "nb", "size")


def local_roots(linked: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, each row's smallest order value among the rows that it reaches."""
    lab = order.copy()
    top = np.iinfo(order.dtype).max
    while True:
        new = np.minimum(lab, np.where(linked, lab[None, :], top).min(axis=1, initial=top))
        if (new == lab).all():
            return lab
        lab = new
