"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a concatenation of random hashes and sorts by it lexicographically: first the nearest of some
pivots, drawn anew from the data for each pass, then signs along random directions as seen from the middle of the pivot's
cell. Drawn and centred so, hashes tell vectors apart in dense cones as well as in even data. Vectors within a bounded
window of the order are compared in double precision, and the verified pairs of all passes are joined into components.
Passes are added until they hardly join components any more; then links are counted exactly inside components, in pairs
of blocks.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, runs
from .components import block_pairs, components
from .tokens import sums

BITS = 40
#: Pivots of a pass at most, rows and bytes of the sample they are drawn from, and rows of a tile of the comparison.
PIVOTS, SAMPLE_ROWS, SAMPLE_BYTES, TILE = 256, 16_384, 32 << 20, 512


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepare(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vkey, vector): vkey is a 128-bit key of the vector's values, null where the vector can link with nothing."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    item = pa.float32() if kind == "float" else pa.float64()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.nan_to_num(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            first = np.r_[0, np.cumsum(size)]
            with np.errstate(over="ignore", invalid="ignore"):
                square = flat * flat
                ok = (sums(~(square < 1e300 / np.repeat(np.maximum(size, 1), size)), first) == 0) & (sums(square > 0, first) > 0)
            flat += 0.0  # one zero
            keys = [hashlib.blake2b(flat[lo:hi].tobytes(), digest_size=16).digest() if good else None for lo, hi, good in zip(first[:-1], first[1:], ok, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(item.to_pandas_dtype())))
            vecs = pa.compute.if_else(pa.array(ok), lists, pa.nulls(len(ok), lists.type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), vecs], ["id", "vkey", "vector"])

    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vector"))
    return src.mapInArrow(go, f"id long, vkey binary, vector array<{kind}>")


class Hashes:
    """The hashes of a few passes for vectors of one length: pivots, the middles of their cells on a bounded sample, directions."""

    def __init__(self, sample: np.ndarray, dim: int, cells: int, seed: list[int]):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((dim, BITS))
        self.pivots = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)] if cells > 1 and len(sample) else np.zeros((1, dim))
        own = (sample @ self.pivots.T).argmax(axis=1)
        middles = np.array([sample[own == c].mean(axis=0) if (own == c).any() else p for c, p in enumerate(self.pivots)])
        self.offsets = middles @ self.directions

    def keys(self, x: np.ndarray) -> np.ndarray:
        cell = (x @ self.pivots.T).argmax(axis=1)
        bits = x @ self.directions >= self.offsets[cell]
        return cell.astype(np.int64) << BITS | bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def sampled(reps: DataFrame, dims: dict[int, int], window: int) -> dict[int, np.ndarray]:
    """Unit vectors of each length that has more rows than a window, a bounded number by the hash of their ids."""
    out = {}
    for dim, n in dims.items():
        if n > window:
            most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
            rows = reps.where(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
            out[dim] = _unit(rows.column(0))
    return out


def sorted_passes(reps: DataFrame, samples: dict[int, np.ndarray], dims: dict[int, int], window: int, first: int, n_passes: int, seed: int) -> DataFrame:
    """(grp, key, id): in pass grp % 65536, of the length grp // 65536, the key by which vectors are ordered.

    Of lengths that have no more rows than a window one pass compares all, so that they are only in pass 0.
    """
    hashes = {(dim, k): Hashes(x, dim, min(PIVOTS, -(-dims[dim] // window)), [seed, dim, k]) for dim, x in samples.items() for k in range(first, first + n_passes)}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            size = pa.compute.list_value_length(vecs).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                own = [k for d, k in hashes if d == dim] or ([0] if first == 0 else [])
                x = _unit(vecs.take(pa.array(at)))
                for k in own:
                    keys = hashes[dim, k].keys(x) if (dim, k) in hashes else np.zeros(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim * 65_536 + k)), pa.array(keys), pa.array(ids[at])], ["grp", "key", "id"])

    return reps.select("id", "vector").mapInArrow(go, "grp long, key long, id long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], ["grp", "id", "part", "pos"])
        at += n


def windows(keys: DataFrame, block: int, window: int, partitions: int) -> DataFrame:
    """(block, rank, grp, id): blocks of the sorted order, each with the first `window` rows of the next one."""
    ordered = keys.repartitionByRange(partitions, "grp", "key", "id").sortWithinPartitions("grp", "key", "id")
    ordered = cut(ordered.mapInArrow(_numbered, "grp long, id long, part long, pos long"))
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    ranked = ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("pos"))
    own = F.expr(f"rank div {block}")
    both = F.when((F.col("rank") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return ranked.select(F.explode(both).alias("block"), "rank", "grp", "id")


def _joined(i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each row's smallest order value among the rows that it reaches over the links i-j."""
    lab = order.copy()
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == lab).all():
            return lab
        lab = new


def _window_edges(threshold: float, window: int, block: int):
    """Links between a block's own rows and the `window` rows after each, tile by tile; of a tile only what joins its components."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["block"]):
            grp, ids, rank, vecs = t.column("grp").to_numpy(), t.column("id").to_numpy(), t.column("rank").to_numpy(), t.column("vector")
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                for one in np.unique(grp[lo:hi]):
                    i = lo + np.flatnonzero(grp[lo:hi] == one)
                    x, own = _unit(vecs.take(pa.array(i))), ids[i]
                    end = np.searchsorted(rank[i], (rank[lo] // block + 1) * block)  # later rows are the next block's
                    for a in range(0, int(end), TILE):
                        b = min(a + TILE, int(end))
                        r, c = np.nonzero(x[a:b] @ x[a : b + window].T >= threshold)
                        r, c = r[c > r] + a, c[c > r] + a
                        if len(r):
                            root = _joined(r - a, c - a, own[a : b + window])
                            far = root != own[a : b + window]
                            yield pa.RecordBatch.from_arrays([pa.array(own[a : b + window][far]), pa.array(root[far])], ["a", "b"])

    return go


def _exact_counts(threshold: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["component", "bi", "bj"]):
            cols = [t.column(c).to_numpy() for c in ("bi", "bj", "blk", "id", "weight")]
            out_id, out_n = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                bi, bj, blk, ids, w = (c[lo:hi] for c in cols)
                x = _unit(t.column("vector").slice(lo, hi - lo))
                left = np.flatnonzero(blk == bi[0])
                right = np.flatnonzero(blk == bj[0])
                linked = x[left] @ x[right].T >= threshold
                if bi[0] == bj[0]:
                    np.fill_diagonal(linked, False)
                else:
                    out_id.append(ids[right])
                    out_n.append(w[left] @ linked)
                out_id.append(ids[left])
                out_n.append(linked @ w[right])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_n).astype(np.int64))], ["id", "n"])

    return go


def _crossing(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b): the components that the edges join, each pair once."""
    of = lambda side: comp.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    return named.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def joined_by_passes(reps: DataFrame, threshold: float, window: int, block: int, recall: float, batch: int, most_passes: int, seed: int) -> DataFrame:
    """(id, component) of the vectors that have links, over as many passes as the data ask for.

    A batch of passes that joins fewer components than the one before says how many are still apart: with a ratio q of the
    last two numbers, c of the last, about c * q / (1 - q). Passes end when that is at most 1 - recall of all that were
    joined. If most_passes come before, a warning says what is estimated to be missing.
    """
    dims = {r[0]: r[1] for r in reps.groupBy(F.size("vector")).count().collect()}  # a row for each length
    samples = sampled(reps, dims, window)
    n = sum(dims.values())
    comp, before, total, first = None, None, 0, 0
    while True:
        parts = max(1, math.ceil(n * batch / 200_000))
        win = windows(cut(sorted_passes(reps, samples, dims, window, first, batch, seed)), block, window, parts)
        dealt = win.join(reps.select("id", "vector"), "id").repartition("block").sortWithinPartitions("block", "grp", "rank")
        edges = cut(dealt.select("block", "grp", "rank", "id", "vector").mapInArrow(_window_edges(threshold, window, block), "a long, b long"))
        first += batch
        if comp is None:
            comp = components(edges)
            total = now = comp.where("id != component").count()
        else:
            across = cut(_crossing(edges, comp))
            up = components(across)
            now = up.where("id != component").count()
            if now:
                top = up.select(F.col("id").alias("component"), F.col("component").alias("_top"))
                more = across.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
                comp = cut(comp.union(more).join(top, "component", "left").select("id", F.coalesce("_top", "component").alias("component")))
            total += now
        if not samples or (before is not None and not now):
            return comp
        ratio = min(now / before, 0.99) if before else None
        if ratio is not None and now * ratio / (1 - ratio) <= (1 - recall) * total:
            return comp
        if first >= most_passes:
            warnings.warn(f"near_vectors: after {first} passes the last {batch} still joined {now} of {total} components", stacklevel=2)
            return comp
        before = now


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, window: int = 2_048, block: int = 4_096,
    recall: float = 0.999, batch: int = 8, most_passes: int = 256, count_block: int = 2_048, seed: int = 7,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, linkable.

    Vectors that are null, empty, zero, or hold null or non-finite components (or such as overflow when squared) link with
    nothing: n_links 0, their own component. Vectors of different lengths never link. Equal vectors are compared once and counted as often as they
    occur. Rows that repeat an id are one vector (the least of the given ones); a null id is left out. Other columns are
    ignored. An empty table gives an empty result. block must be at least window.
    """
    single = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(vec_col).alias(vec_col))
    base = cut(prepare(single, id_col, vec_col))
    valid = base.where("vkey is not null")
    classes = valid.groupBy("vkey").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    reps = cut(valid.join(classes, "vkey").where("id = rep").select("id", "vector", "weight"))
    comp = joined_by_passes(reps, threshold, window, max(block, window), recall, batch, most_passes, seed)
    members = comp.join(reps, "id")
    pairs = block_pairs(members, count_block).repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    links = pairs.select("component", "bi", "bj", "blk", "id", "weight", "vector").mapInArrow(_exact_counts(threshold), "id long, n long")
    links = links.groupBy("id").agg(F.sum("n").alias("n"))
    found = classes.join(comp.join(links, "id").withColumnRenamed("id", "rep"), "rep", "left")
    full = base.select("id", "vkey").join(found, "vkey", "left")
    return full.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        (F.coalesce("component", "rep", "id") == F.col("id")).alias("kept"),
        F.col("vkey").isNotNull().alias("linkable"),
    )
