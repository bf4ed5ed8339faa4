"""Token counts of documents in flat token files without an index, by a scan for separators.

A file is a run of little-endian token identifiers; an end-of-document identifier closes each document. Tasks read blocks
of bytes that begin at any whole token. Each block is searched vectorised for the identifier; a prefix scan
over block summaries, in two levels so that no task reads more than a stretch of a file's blocks, then tells each block how many documents
precede it and how many tokens of an open document it continues.
"""

from __future__ import annotations

import base64
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, filesystem, remove, shared_dir, slices, strings

STRETCH = 1024  # blocks whose summaries are scanned together


DTYPES = {1: "<u1", 2: "<u2", 4: "<u4"}


def block_ranges(files: DataFrame, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, path, block, offset, size): byte ranges of files (file, path, length), whole tokens each; an empty file has one of size 0."""
    size = F.lit(block_tokens * width).cast("bigint")
    whole = F.col("length") - F.col("length") % width
    last = F.greatest(F.ceil(whole / size).cast("bigint"), F.lit(1)) - 1
    cut = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return cut.select("file", "path", "block", (F.col("block") * size).alias("offset"), F.greatest(F.least(size, whole - F.col("block") * size), F.lit(0)).alias("size"))


def read_flat(spark: SparkSession, path: str, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """(file, path, block, offset, size) of flat files of any length; a file's odd bytes at its end, less than a token, are left out.

    Only names and lengths are listed; tasks read their byte ranges, 32 blocks a task.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "path", "length")
    blocks = files.agg(F.sum(F.ceil(F.col("length") / (block_tokens * width)))).first()[0] or 1
    return block_ranges(files, width, block_tokens).repartition(max(1, math.ceil(int(blocks) / 32)), "file", "block")


def _scan(width: int, eod: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = (None, None)
        for b in batches:
            n, ends = [], []
            for path, offset, size in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if opened[0] != path:
                    if opened[1] is not None:
                        opened[1].close()
                    system, at = filesystem(path)
                    opened = path, system.open_input_file(at)
                ids = np.frombuffer(opened[1].read_at(size, offset), DTYPES[width])
                n.append(len(ids))
                ends.append(np.flatnonzero(ids == eod))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(e) for e in ends])].astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), lists], ["file", "block", "n_tokens", "ends"])
        if opened[1] is not None:
            opened[1].close()

    return go


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """(file, block, n_tokens, ends): each block's tokens, and the places of the separators that the search finds in it."""
    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "path", "offset", "size").mapInArrow(_scan(width, eod), f"file {kind}, block long, n_tokens long, ends array<bigint>")


def stitch(scanned: DataFrame, open_tail: bool = True) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): the documents of each file, without their separators.

    start: tokens of the file before the document. Tokens after the last separator are a document that is not closed,
    unless open_tail is false. Two separators side by side enclose a document of 0 tokens.
    """
    s = scanned.withColumn("stretch", F.expr(f"block div {STRETCH}")).withColumn("n_ends", F.size("ends"))
    s = s.withColumn("tail", F.when(F.col("n_ends") > 0, F.col("n_tokens") - F.element_at("ends", -1) - 1).otherwise(F.col("n_tokens")))
    brief = s.select("file", "stretch", "block", "n_tokens", "n_ends", "tail")
    # a block's summary, and how two join: tokens and separators add up, a tail grows until a separator cuts it
    inner = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = brief.groupBy("file", "stretch").agg(F.sum("n_tokens").alias("t"), F.sum("n_ends").alias("e"), F.max(F.when(F.col("n_ends") > 0, F.struct("block", "tail"))).alias("cut"))
    after = brief.alias("b").join(totals.select("file", "stretch", F.col("cut.block").alias("at")).alias("c"), ["file", "stretch"])
    rest = after.where("at is null or block > at").groupBy("file", "stretch").agg(F.sum("n_tokens").alias("rest"))
    totals = totals.join(rest, ["file", "stretch"], "left").withColumn("tail", F.coalesce("cut.tail", F.lit(0)) + F.coalesce("rest", F.lit(0)))
    outer = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)

    def carried(w: Window, tokens: str, ends: str) -> list:
        before = F.coalesce(F.sum(tokens).over(w), F.lit(0))
        last = F.max(F.when(F.col(ends) > 0, F.col("pos"))).over(w)  # end of the tail that a separator opened, in tokens
        return [before, F.coalesce(F.sum(ends).over(w), F.lit(0)), last]

    run = F.sum("t").over(Window.partitionBy("file").orderBy("stretch"))
    t = totals.withColumn("pos", run - F.col("tail"))
    before, ends, last = carried(outer, "t", "e")
    t = t.select("file", "stretch", before.alias("t0"), ends.alias("e0"), F.coalesce(last, F.lit(0)).alias("open0"))
    b = s.join(t, ["file", "stretch"])
    b = b.withColumn("pos", F.col("t0") + F.sum("n_tokens").over(Window.partitionBy("file", "stretch").orderBy("block")) - F.col("tail"))
    before, ends, last = carried(inner, "n_tokens", "n_ends")
    b = b.select("file", "block", "n_tokens", "n_ends", "ends", (F.col("t0") + before).alias("at"), (F.col("e0") + ends).alias("ordinal"), F.coalesce(last, "open0").alias("opened"))
    one = b.where("n_ends > 0").select("file", "at", "ordinal", "opened", "ends", F.posexplode("ends").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("at") + F.try_element_at("ends", F.col("k")) + 1)
    closed = one.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), begin.alias("start"), (F.col("at") + F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    if not open_tail:
        return closed
    whole = b.groupBy("file").agg(F.sum("n_tokens").alias("t"), F.sum("n_ends").alias("ordinal"), F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.element_at("ends", -1) + 1)).alias("start"))
    tail = whole.withColumn("start", F.coalesce("start", F.lit(0))).where("t > start")
    return closed.union(tail.select("file", "ordinal", "start", (F.col("t") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")))


class _Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:  # a vocabulary file that every machine has at the same place
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Token identifiers of a whole text, whatever its length."""
        return np.asarray(self.encoding.encode_ordinary(text), np.uint32)


def _write(folder: str, vocabulary: str, eod: int, width: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, file, dtype = _Encoder(vocabulary), TaskContext.get().partitionId(), DTYPES[width]
        system, root = filesystem(folder)
        name = f"{file:06d}-{uuid.uuid4().hex}.bin"  # a task that runs again writes another file; only a finished one's is named
        length, ordinal, id_type = 0, 0, None
        names = ["file", "path", "length", "ordinal", "doc_ids"]
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                id_type = batch.schema.field(0).type
                for b in slices(batch, "text"):
                    parts = []
                    for text in strings(b.column(1)):
                        ids = enc.ids(text)
                        if max(eod, int(ids.max(initial=0))) > np.iinfo(dtype).max:
                            raise OverflowError(f"an identifier does not fit {width} bytes")
                        parts += [ids.astype(dtype), np.array([eod], dtype)]
                    data = np.concatenate(parts).tobytes()
                    out.write(data)
                    length += len(data)
                    ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([ordinal], pa.int64()), ids], names)
                    ordinal += b.num_rows
        if id_type is not None:
            last = [pa.array([file], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([length], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(id_type))]
            yield pa.RecordBatch.from_arrays(last, names)

    return go


def write_flat(docs: DataFrame, folder: str, vocabulary: str, eod: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' tokens as flat files in a shared folder, one for each input partition, a separator after each document.

    Returns what a list of the files holds, and nothing about lengths of documents: rows (file, path, length) name a
    file, rows (file, ordinal, doc_ids) the documents from the ordinal-th of the file on. Cut from its lineage, so that
    files and list come from one reading.
    """
    system, root = filesystem(folder)
    system.create_dir(root, recursive=True)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return cut(src.mapInArrow(_write(folder, vocabulary, eod, width), f"file long, path string, length long, ordinal long, doc_ids array<{kind}>"))


def default_vocabulary() -> str:
    return os.environ.get("LODESTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, vocabulary: str | None = None, eod: int = 50256, width: int = 2, block_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the documents are written as flat token files, and their lengths found by the separator scan of those files.

    Whole texts are encoded, however long. Null and empty texts have 0 tokens. Rows that repeat an id are documents of
    their own, and null ids stay. Other columns are ignored. An empty table gives an empty result. The files lie in the
    session's checkpoint folder, which tasks reach by Arrow's file systems, and are deleted once the counts are written.
    """
    folder = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    listed = write_flat(docs, folder, vocabulary or default_vocabulary(), eod, width, id_col, text_col)
    blocks = block_ranges(listed.where("path is not null").select("file", "path", "length"), width, block_tokens)
    found = stitch(cut(scan_blocks(blocks, eod, width)), open_tail=False)
    named = listed.where("path is null").select("file", "ordinal", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")
    out = cut(named.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens"))
    remove(folder)
    return out
