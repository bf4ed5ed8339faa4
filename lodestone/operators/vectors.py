"""Vector operators: metrics as Columns, exact and cluster-pruned top-k for a set of queries, embedding of texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

METRICS = ("COSINE", "IP", "L2")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 if one of the vectors has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def metric(kind: str, a: Column, b: Column) -> Column:
    """COSINE, IP and L2 of numbers; HAMMING, JACCARD and TANIMOTO of arrays of bits."""
    if kind == "COSINE":
        return cosine(a, b)
    if kind == "IP":
        return dot(a, b)
    if kind == "L2":
        return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    both, one = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y)), _sum(F.zip_with(a, b, lambda x, y: F.greatest(x, y).cast("double")))
    if kind == "HAMMING":
        return one - both
    if kind in ("JACCARD", "TANIMOTO"):
        share = F.when(one == 0, 1.0).otherwise(both / one)
        return 1 - share if kind == "JACCARD" else -F.log2(share)
    raise ValueError(f"unknown metric {kind!r}")


def invalid_vectors(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Rows whose vector is null, empty, of another length or holds a null, with the reason."""
    v = F.col(col)
    reason = F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != dim, "dimension").when(F.exists(v, lambda x: x.isNull()), "null_component")
    return df.withColumn("reason", reason).where("reason is not null")


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


#: Blocks of vectors hold about this many bytes, and a block of queries at most this many rows.
BLOCK_BYTES, QUERY_ROWS = 1 << 20, 1_024
#: Scores that a task holds at a time, whatever the blocks; more tied rows than that are never held either.
TILE = 1 << 19


def _sample(vectors: DataFrame, vec_col: str, most: int, dim: int | None = None) -> np.ndarray:
    """Unit vectors of at most `most` rows, by the hash of the vector; those that have no length or another than the first are left out."""
    rows = vectors.select(vec_col).where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(vec_col), vec_col).limit(most).toPandas()[vec_col]
    lists = [np.asarray(v, np.float64) for v in rows]
    dim = dim or next((len(v) for v in lists if len(v)), 0)
    x = np.array([v for v in lists if len(v) == dim]).reshape(-1, dim)
    x = x[np.isfinite(x).all(axis=1)]
    n = np.linalg.norm(x, axis=1)
    return x[n > 0] / n[n > 0, None]


def _whole(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of each length of vectors, without those that are null, empty or hold a null."""
    size = np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = col.flatten()
    begin = np.cumsum(size) - size
    gaps = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    ok = (size > 0) & (gaps[begin + size] == gaps[begin])
    values = flat.to_numpy(zero_copy_only=False)
    for dim in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == dim))
        yield at, values[begin[at, None] + np.arange(dim)]


def pack(rows: DataFrame, id_col: str, vec_col: str, by: str | None = None, most: int = 1 << 20) -> DataFrame:
    """(part, dim, ids, data): vectors of one length and one value of `by` (an int; without it 0) as blocks of bytes.

    A block has at most `most` rows and BLOCK_BYTES bytes, so that what meets another block in a join is of bounded size.
    Vectors that are null, empty or hold nulls are left out.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, part = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for at, x in _whole(b.column(1)):
                n = max(1, min(most, BLOCK_BYTES // (4 * x.shape[1])))
                x = x.astype(np.float32)
                order = np.argsort(part[at], kind="stable")
                edges = np.r_[0, np.flatnonzero(np.diff(part[at][order])) + 1, len(at)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    for k in range(lo, hi, n):
                        own = order[k : min(k + n, hi)]
                        cells = [[int(part[at[own[0]]])], [x.shape[1]], [ids[at[own]].astype(np.int64).tobytes()], [x[own].tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "dim", "ids", "data"])

    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), (F.col(by) if by else F.lit(0)).cast("int").alias("part"))
    return src.where("id is not null").mapInArrow(go, "part int, dim int, ids binary, data binary")


def _scores(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """Greater is better; L2 negated."""
    if kind == "COSINE":
        qn, xn = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        n = qn[:, None] * xn[None, :]
        return np.divide(q @ x.T, n, out=np.zeros((len(q), len(x))), where=n > 0)
    if kind == "IP":
        return q @ x.T
    return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0))


def _best_of_blocks(k: int, kind: str):
    """The k best rows of each block for each query of the block that it met; what a block cannot hold among its k best is not among the best of all."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                asked, own = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (1, 3))
                whole, x = (np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(-1, dim).astype(np.float64) for c in (2, 4))
                n, step = min(k, len(own)), max(1, TILE // len(own))
                for at in range(0, len(whole), step):
                    s = _scores(whole[at : at + step], x, kind)
                    shown = np.round(s, 12)
                    least = np.partition(shown, len(own) - n, axis=1)[:, len(own) - n]
                    row, col = np.nonzero(shown >= least[:, None])
                    order = np.lexsort((own[col], -shown[row, col], row))
                    row, col = row[order], col[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
                    row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at + row]), pa.array(own[col]), pa.array(s[row, col])], ["query_id", "id", "score"])

    return go


def _held_against(asked: DataFrame, blocks: DataFrame, kernel: Callable, schema: str, at_a_time: int = 64) -> DataFrame:
    """What the kernel gives for each meeting of a block of queries with a block of rows of its part and length.

    at_a_time blocks of queries are in a broadcast, which so holds at_a_time * BLOCK_BYTES at most; the rows are read once for each.
    """
    asked = cut(asked)
    turns = max(1, -(-asked.count() // at_a_time))
    numbered = asked.withColumn("turn", F.pmod(F.xxhash64("part", "dim", "ids"), F.lit(turns)))
    out = None
    for turn in range(turns):
        own = numbered.where(F.col("turn") == turn).select("part", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        pairs = blocks.join(F.broadcast(own), ["part", "dim"]).select("dim", "q_ids", "q_data", "ids", "data")
        one = pairs.mapInArrow(kernel, schema)
        out = one if out is None else out.union(one)
    return out


HITS = "query_id long, id long, score double"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, blk, dim, pos): where each query stands in its block."""
    for b in batches:
        for i in range(b.num_rows):
            ids = np.frombuffer(b.column(2)[i].as_buffer(), np.int64)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, b.column(0)[i].as_py())), pa.array(np.full(n, b.column(1)[i].as_py(), np.int32)), pa.array(np.arange(n))], ["query_id", "blk", "dim", "pos"])


def _packed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blk, dim, ids, data, rows, pos): rows of one block of queries and one length, with the pairs (row, query) that are
    asked for: TILE of them at most, or one row's."""
    for b in batches:
        blk, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        lists = b.column(3)
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        pos, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        for at, x in _whole(b.column(1)):
            most = max(1, BLOCK_BYTES // (4 * x.shape[1]))
            order = np.argsort(blk[at], kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(blk[at][order])) + 1, len(at)]
            pairs = np.r_[0, np.cumsum(size[at][order])]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                k = lo
                while k < hi:
                    top = max(k + 1, min(k + most, hi, int(np.searchsorted(pairs, pairs[k] + TILE, "right")) - 1))
                    own, k = order[k:top], top
                    n = size[at[own]]
                    which = np.repeat(begin[at[own]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    cells = [int(blk[at[own[0]]]), x.shape[1], ids[at[own]].tobytes(), x[own].astype(np.float32).tobytes(), np.repeat(np.arange(len(own), dtype=np.int32), n).tobytes(), pos[which].astype(np.int32).tobytes()]
                    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["blk", "dim", "ids", "data", "rows", "pos"])


def _best_of_pairs(k: int, kind: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                asked, own = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in (1, 3))
                rows, pos = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in (5, 6))
                q, x = (np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(-1, dim).astype(np.float64) for c in (2, 4))
                s = np.empty(len(rows))
                for lo in range(0, len(rows), 65_536):
                    s[lo : lo + 65_536] = _pair_scores(q[pos[lo : lo + 65_536]], x[rows[lo : lo + 65_536]], kind)
                order = np.lexsort((own[rows], -np.round(s, 12), pos))
                order = order[np.arange(len(order)) - np.searchsorted(pos[order], pos[order]) < k]
                yield pa.RecordBatch.from_arrays([pa.array(asked[pos[order]]), pa.array(own[rows[order]]), pa.array(s[order])], ["query_id", "id", "score"])

    return go


def _pair_scores(q: np.ndarray, x: np.ndarray, kind: str) -> np.ndarray:
    """_scores of row i with row i."""
    if kind == "L2":
        return -np.sqrt(((q - x) ** 2).sum(axis=1))
    s = (q * x).sum(axis=1)
    if kind == "COSINE":
        n = np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)
        s = np.divide(s, n, out=np.zeros(len(s)), where=n > 0)
    return s


def _within(queries: DataFrame, vectors: DataFrame, within: DataFrame, k: int, kind: str, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, id, score) of the best of the pairs (query_id, id): a row's vector travels once for each block of queries that
    may see it, with the places of these queries, and blocks of such rows meet the block of queries."""
    asked = cut(pack(queries, "query_id", "embedding", most=QUERY_ROWS).withColumn("blk", F.xxhash64("dim", "ids")))
    place = asked.select("blk", "dim", "ids").mapInArrow(_place, "query_id long, blk long, dim int, pos long")
    seen = within.select("query_id", "id").join(place, "query_id").groupBy("id", "blk", "dim").agg(F.collect_list("pos").alias("pos"))  # a block of queries at most
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"))
    rows = seen.join(src, "id").where(F.size("vector") == F.col("dim")).select("blk", "vector", "id", "pos").sortWithinPartitions("blk")
    packed = rows.mapInArrow(_packed_pairs, "blk long, dim int, ids binary, data binary, rows binary, pos binary")
    met = packed.join(asked.select("blk", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "blk")
    return met.select("dim", "q_ids", "q_data", "ids", "data", "rows", "pos").mapInArrow(_best_of_pairs(k, kind), HITS)


def bit_statistics(queries: DataFrame, rows: DataFrame, query_col: str = "bits", row_col: str = "bits") -> DataFrame:
    """(query_id, n, hamming, jaccard): over all rows (id, bits) the number, the greatest Hamming and the sum of the Jaccard
    distances to each query (query_id, bits); bits are arrays of 0 and 1. Two vectors without ones have distance 0."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                q, x = (np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(-1, dim) for c in (2, 4))
                both = (q @ x.T).astype(np.float64)
                one = q.sum(axis=1)[:, None] + x.sum(axis=1)[None, :] - both
                share = np.divide(both, one, out=np.ones(both.shape, np.float64), where=one > 0)
                asked = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.full(len(asked), len(x))), pa.array((one - both).max(axis=1).astype(np.float64)), pa.array((1 - share).sum(axis=1))], ["query_id", "n", "hamming", "jaccard"])

    found = _held_against(pack(queries, "query_id", query_col, most=QUERY_ROWS), pack(rows, "id", row_col), go, "query_id long, n long, hamming double, jaccard double")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("hamming").alias("hamming"), F.sum("jaccard").alias("jaccard"))


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, kind: str = "COSINE", id_col: str = "vec_id", vec_col: str = "embedding", within: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of each query (query_id, embedding), ties by id.

    Queries are a stated set that is held against all rows: both sides are packed in blocks, blocks of queries meet blocks
    of rows, and each meeting gives its k best, which are then ranked. within (query_id, id) restricts the search to
    pairs, by a join. Vectors that are null, hold nulls or are of another length than the query's are no hits.
    """
    if kind not in METRICS:
        raise ValueError(f"unknown metric {kind!r}")
    if within is not None:
        scored = _within(queries, vectors, within, k, kind, id_col, vec_col)
    else:
        scored = _held_against(pack(queries, "query_id", "embedding", most=QUERY_ROWS), pack(vectors, id_col, vec_col), _best_of_blocks(k, kind), HITS)
    ranked = _ranked(scored, k)
    return ranked.withColumn("score", -F.col("score")) if kind == "L2" else ranked


def fit_clusters(vectors: DataFrame, n_clusters: int = 128, sample: int = 32_768, rounds: int = 12, vec_col: str = "embedding", seed: int = 1) -> np.ndarray:
    """Centroids of unit vectors (spherical k-means) on at most `sample` rows, by the hash of the vector."""
    x = _sample(vectors, vec_col, sample)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n_clusters, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        at, first = np.unique(own[order], return_index=True)
        total = np.zeros_like(c)
        total[at] = np.add.reduceat(x[order], first) if len(at) else 0.0
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1e-12), c)
    return c


def probes_for(vectors: DataFrame, centroids: np.ndarray, k: int = 10, recall: float = 0.97, least: int = 16, sample: int = 20_000, asked: int = 200, vec_col: str = "embedding") -> int:
    """The fewest clusters to probe with which a bounded sample's own neighbours, found by brute force, reach the recall."""
    x = _sample(vectors, vec_col, sample, centroids.shape[1])
    q = x[:asked]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    own = (x @ centroids.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(min(len(centroids), max(least, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))) if len(needed) else least


def assign_clusters(vectors: DataFrame, centroids: np.ndarray, n: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector, cluster): the n nearest clusters of every vector of the centroids' length."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _whole(b.column(1)):
                if x.shape[1] == centroids.shape[1]:
                    own = np.argsort(-(x.astype(np.float64) @ centroids.T), axis=1, kind="stable")[:, :n]
                    idx = pa.array(np.repeat(at, own.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(own.ravel().astype(np.int32))], ["id", "vector", "cluster"])

    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vector"))
    return src.mapInArrow(go, "id long, vector array<float>, cluster int")


def write_clusters(vectors: DataFrame, path: str, centroids: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Stores the index: the centroids, and the vectors as packed blocks in a folder for each cluster.

    A cluster of any size is many blocks, written by as many tasks as Spark finds even. Vectors of another length than the
    centroids', null ones and those that hold nulls are not in the index.
    """
    spark = vectors.sparkSession
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    dealt = assign_clusters(vectors, centroids, 1, id_col, vec_col).hint("rebalance", "cluster").sortWithinPartitions("cluster")
    pack(dealt, "id", "vector", "cluster").write.partitionBy("part").parquet(f"{path}/blocks")


def stored_top_k(queries: DataFrame, path: str, k: int, probes: int = 16) -> DataFrame:
    """dense_top_k by cosine over the `probes` nearest clusters of each query, of the index that write_clusters stored.

    Only the folders of probed clusters are read; blocks of the queries that probe a cluster are shuffled to the cluster's
    blocks, as they are as many copies of the queries as clusters are probed. Queries that probe every cluster are not
    dealt by clusters: each block of them meets each block of rows.
    """
    spark = queries.sparkSession
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()  # a row for each cluster
    centroids = np.array([r.centroid for r in rows])
    stored = spark.read.schema("dim int, ids binary, data binary, part int").parquet(f"{path}/blocks")
    if probes >= len(centroids):
        asked = pack(queries.where(F.size("embedding") == centroids.shape[1]), "query_id", "embedding", most=QUERY_ROWS)
        return _ranked(_held_against(asked, stored.withColumn("part", F.lit(0)), _best_of_blocks(k, "COSINE"), HITS), k)
    dealt = assign_clusters(queries, centroids, probes, "query_id", "embedding").hint("rebalance", "cluster").sortWithinPartitions("cluster")
    asked = cut(pack(dealt, "id", "vector", "cluster", QUERY_ROWS))
    probed = [r[0] for r in asked.select("part").distinct().collect()]  # a row for each cluster
    own = asked.select("part", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    pairs = stored.where(F.col("part").isin(probed)).join(own.hint("shuffle_merge"), ["part", "dim"]).select("dim", "q_ids", "q_data", "ids", "data")
    return _ranked(pairs.mapInArrow(_best_of_blocks(k, "COSINE"), HITS), k)


def hashed_embedding(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for an embedding model: signed hashed words, unit length."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def embed(df: DataFrame, text_col: str = "parsed_text", function: Callable[[list[str]], np.ndarray] = hashed_embedding, batch: int = 2_048, name: str = "embedding") -> DataFrame:
    """df with the vectors that the function gives for its texts, at most `batch` of them a call."""
    names = df.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                v = np.asarray(function([x or "" for x in b.column(text_col).to_pylist()]), np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, flat], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(go, f"{schema}, `{name}` array<float>")
