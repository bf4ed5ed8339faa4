"""A stored keyword index: postings in folders of term buckets, changed by deltas.

Every change is a generation: its new postings and documents, and the keys that it takes out. A generation counts once its
row in `done` is written, which comes last, so that a run that fails leaves nothing that is read and its number is used
again. A posting is live while no later generation takes its document out. `compacted` merges all into one generation.
The last bucket holds a row of the empty term for each document, so that a change splits each text once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import keyword
from ..operators.joins import small

BUCKETS = 64
_POSTINGS, _GONE, _DONE = "doc_key {0}, dl int, term string, tf long, gen long, bucket int", "doc_key {0}, gen long", "documents long, postings long, gen long"


def _bucket(term: Column | str) -> Column:
    """The folder of a term; that of the empty one comes after all others."""
    own = F.col(term) if isinstance(term, str) else term
    return F.when(own == "", BUCKETS).otherwise(F.pmod(F.xxhash64(own), F.lit(BUCKETS))).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of its schema where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class Index:
    """The index in a folder. kind: the type of document keys."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long"):
        self.spark, self.path, self.kind = spark, path, kind

    def _table(self, name: str, schema: str) -> DataFrame:
        return _read(self.spark, f"{self.path}/{name}", schema.format(self.kind))

    def generations(self) -> list[int]:
        """Numbers of the changes that count; one for each change since the last compaction."""
        return sorted(r[0] for r in self._table("done", _DONE).select("gen").collect())

    def _live(self, rows: DataFrame) -> DataFrame:
        own = self.generations()
        gone = self._table("gone", _GONE).where(F.col("gen").isin(own)).groupBy("doc_key").agg(F.max("gen").alias("_gone"))
        some = rows.where(F.col("gen").isin(own))
        return some.join(small(gone), "doc_key", "left").where("_gone is null or _gone <= gen").drop("_gone")

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_key, dl, term, tf): what is live, of some buckets or of all; only their folders are read."""
        rows = self._table("postings", _POSTINGS).where(F.col("bucket") < BUCKETS)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return self._live(rows).select("doc_key", "dl", "term", "tf")

    def documents(self) -> DataFrame:
        """(doc_key, dl) of all documents, those without terms too."""
        return self._live(self._table("postings", _POSTINGS).where(F.col("bucket") == BUCKETS)).select("doc_key", "dl")

    def _write(self, rows: DataFrame, gen: int) -> None:
        """A generation's rows (doc_key, dl, term, tf) in their folders, then its line in `done`."""
        dealt = rows.withColumn("bucket", _bucket("term")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={gen}")
        own = self._table("postings", _POSTINGS).where(F.col("gen") == gen)
        sizes = own.agg(F.count_if(F.col("bucket") == BUCKETS).alias("documents"), F.count_if(F.col("bucket") < BUCKETS).alias("postings"))
        self.spark.createDataFrame(sizes.collect(), "documents long, postings long").write.mode("overwrite").parquet(f"{self.path}/done/gen={gen}")

    def change(self, texts: DataFrame, removed: DataFrame | None = None) -> int:
        """texts (doc_key, text) are added or take the place of what their keys had; removed (doc_key) go. The new generation."""
        gen = max(self.generations(), default=-1) + 1
        split = texts.select("doc_key", keyword.terms("text").alias("_t")).withColumn("dl", F.size("_t"))
        words = keyword.as_postings(keyword.counted(split.withColumn("_t", F.array_append("_t", F.lit(""))), "_t"))
        keys = texts.select("doc_key") if removed is None else texts.select("doc_key").union(removed.select("doc_key"))
        if gen:
            keys.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/gen={gen}")
        self._write(words, gen)
        return gen

    def compacted(self, path: str) -> Index:
        """The live rows as the one generation of an index in another folder."""
        new = Index(self.spark, path, self.kind)
        new._write(self._live(self._table("postings", _POSTINGS)).select("doc_key", "dl", "term", "tf"), 0)
        return new

    def bm25(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_key, score) for asked (query_id, term), with k at least the k best of each query: only the buckets of asked terms are read."""
        buckets = [r[0] for r in asked.select(_bucket("term")).distinct().collect()]  # BUCKETS at most
        n, avgdl = self.documents().agg(F.count("*"), F.avg("dl")).first()
        hits = self.postings(buckets).join(small(asked.select("term").distinct()), "term", "left_semi")
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        whole = hits.repartition("doc_key").groupBy("doc_key", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("_p"))  # the asked terms at most
        return keyword.scores_of(asked, whole.select("doc_key", "dl", F.col("_p.term").alias("terms"), F.col("_p.tf").alias("tfs")), df, n, avgdl or 1.0, k)
