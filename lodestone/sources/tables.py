"""Reading, writing and keyed changes of Parquet tables.

Changes are DataFrames of the whole new table: the caller writes them beside the old one and swaps, as plain Parquet has
no transactions. Keys are compared with equality; rows with a null key match nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, where: Column | str | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """Filtered and projected scan; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*fields) if fields is not None else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, shared by all executors. A local session without one gets a temporary one; a cluster must name it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so that what is built on it computes it once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def row_key(*cols: str) -> Column:
    """A deterministic 64-bit key of the columns, for tables whose store would number rows itself."""
    return F.xxhash64(*cols)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("group_id",)) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key. Of several new rows of a key the caller keeps one."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Partial update: columns of changes that are not null replace those of old; keys that old lacks are left out."""
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = old.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns])


def delete_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is not true (null counts as not true)."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.where(~F.coalesce(p, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti")


def missing_keys(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(existing.select(key), key, "left_anti")


def affected(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """(table, deleted): rows of each table that a delete by keys removes."""
    key = keys.columns
    parts = [df.join(keys, key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def name_parts(name: Column | str) -> tuple[Column, Column]:
    """(group_id, db_type) of a table name TB_{group}_{type}; null and 'unknown' with fewer than three parts."""
    p = F.split(F.col(name) if isinstance(name, str) else name, "_")
    ok = F.size(p) >= 3
    return F.when(ok, F.try_element_at(p, F.lit(2)).try_cast("bigint")), F.when(ok, F.try_element_at(p, F.lit(3))).otherwise("unknown")


def catalog_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(db_type, group_id, row_count) of several tables that have a group_id."""
    out = None
    for kind, df in tables.items():
        one = df.groupBy("group_id").agg(F.count("*").alias("row_count")).select(F.lit(kind).alias("db_type"), "group_id", "row_count")
        out = one if out is None else out.union(one)
    return out


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, extension, file_size, hash_sha256) of files: content is read once, hashed and dropped."""
    df = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("hash_sha256"))


def export_logs(logs: DataFrame, columns: list[str], most_rows: int = 10_000) -> DataFrame:
    """The newest rows for a CSV export: the row limit is the feature."""
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(most_rows).select(*columns)


def write_counted(df: DataFrame, path: str, expected: int | None = None, partition_by: tuple[str, ...] = (), **options) -> int:
    """Writes df and returns how many rows went out, counted by the write itself; a different expectation is an error."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(options.pop("mode", "errorifexists")).options(**options).partitionBy(*partition_by).parquet(path)
    n = int(seen.get["n"])
    if expected is not None and n != expected:
        raise ValueError(f"{n} of {expected} rows were written to {path}")
    return n


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path and a function that makes its paths; for renames and deletes by the driver."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def remove(spark: SparkSession, path: str) -> None:
    store, to = _store(spark, path)
    store.delete(to(path), True)


def _escaped(spark: SparkSession, value) -> str:
    """The value as Spark writes it in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))


def exists(spark: SparkSession, path: str) -> bool:
    store, to = _store(spark, path)
    return store.exists(to(path))


def change_partitions(spark: SparkSession, path: str, by: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list:
    """Rewrites the folders of a table partitioned by `by` that keys (by, ...) name, and no others; the values of `by`.

    change gets the rows of these folders and gives those that take their place. They are written to the shared folder
    first, as a table cannot be read while it is overwritten; folders without rows are deleted. A null in `by` is an error.
    """
    values = [r[0] for r in keys.select(by).distinct().collect()]  # a row for each folder
    if None in values:
        raise ValueError(f"{by} is null in some keys")
    there = exists(spark, path)
    old = spark.read.parquet(path) if there else None
    kind = keys.schema[by].dataType
    own = old.withColumn(by, F.col(by).cast(kind)).where(F.col(by).isin(values)) if there else None
    new = cut(change(own))
    left = {r[0] for r in new.select(by).distinct().collect()}
    if not left <= set(values):
        raise ValueError(f"rows of other folders than those that are rewritten: {sorted(left - set(values))[:5]}")
    if left:
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for v in set(values) - left:
        remove(spark, f"{path}/{by}={_escaped(spark, v)}")
    return values


def upsert_into(spark: SparkSession, path: str, by: str, new: DataFrame, keys: list[str]) -> list:
    """upsert in place: rows of new replace those of the same keys in the same folder; other folders stay as they are."""
    return change_partitions(spark, path, by, new, lambda old: upsert(old, new, [by, *keys]))


def delete_from(spark: SparkSession, path: str, by: str, keys: DataFrame) -> list:
    """Deletes the rows that keys (by, ...) name; other folders stay as they are."""
    return change_partitions(spark, path, by, keys, lambda old: delete_keys(old, keys))


def write_csv(df: DataFrame, path: str) -> None:
    """df, a bounded and ordered result, as one CSV file with a header, which is seen whole or not at all.

    Fields with commas, quotes or line ends are quoted, quotes doubled; nulls are empty. Spark writes the file in a folder
    of its own, whose one file is then renamed.
    """
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.options(header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    store, to = _store(spark, folder)
    part = next(f.getPath() for f in store.listStatus(to(folder)) if f.getPath().getName().startswith("part-"))
    store.delete(to(path), False)
    if not store.rename(part, to(path)):
        raise OSError(f"{path} could not be written")
    store.delete(to(folder), True)


def write_evaluation(header: DataFrame, details: DataFrame, path: str, expected: int | None = None) -> int:
    """Details first, then the header, so that a header is only seen with its details; returns the number of details."""
    n = write_counted(details, f"{path}/evaluation_details", expected, mode="append")
    header.withColumn("item_count", F.lit(n)).write.mode("append").parquet(f"{path}/evaluations")
    return n
