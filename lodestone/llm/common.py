"""Helpers that the operators of this subpackage share: lineage cuts, Arrow batches, contiguous groups."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set a local session gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def filesystem(uri: str) -> tuple:
    """The Arrow file system of a folder or file that Spark names, and the path in it; for tasks and driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def remove(uri: str) -> None:
    """Deletes a folder that this library made in the shared folder."""
    system, path = filesystem(uri)
    system.delete_dir(path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: later steps neither recompute it nor depend on executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a folder of its own in the shared folder and read back, and the folder, which is to be removed when nothing reads it any more."""
    folder = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: it does so once the driver's memory of them is collected,
    which in a driver that needs little memory may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")


def strings(column: pa.Array) -> list[str]:
    """Python strings; nulls as empty ones."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about most_bytes of text each (a longer text stays whole, alone)."""
    col = batch.column(column)
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    lo = 0
    total = 0.0
    for i, size in enumerate(sizes):
        if total and total + size > most_bytes:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0.0
        total += size
    if lo < len(sizes):
        yield batch.slice(lo)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """For input sorted by integer keys: tables of whole groups, with the positions where groups begin (and the end)."""
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in cols)
        at = np.flatnonzero(change)
        if not len(at):
            carry.append(batch)
            continue
        done = [*carry, batch.slice(0, at[-1])] if at[-1] else carry
        before = sum(b.num_rows for b in carry)
        yield pa.Table.from_batches(done), np.unique(np.r_[0, before + at])
        carry = [batch.slice(at[-1])]
    if carry:
        whole = pa.Table.from_batches(carry)
        yield whole, np.array([0, whole.num_rows])


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted table, -1 where it is not in it."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def find_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The same for many values: looked up in their order, which a large table answers several times as fast."""
    order = np.argsort(values)
    out = np.empty(len(values), int)
    out[order] = find(table, values[order])
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each once (np.unique hashes integers, which takes many times as long)."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def planes(x: np.ndarray) -> bytes:
    """64-bit values byte place by byte place, so that places that differ little take little room in a shuffle."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: pa.Buffer, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()
