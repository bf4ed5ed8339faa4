"""Jaccard join of documents on word shingles, with Bayesian candidate pruning.

Texts of equal words form one class and are compared once. MinHash bands name candidates; within a band's bucket, pairs
are compared on ever more MinHash values and dropped as soon as the posterior probability that their similarity reaches
the threshold falls below a tolerance. What is left joins classes into candidate components, and all pairs inside those
are verified on the whole shingle sets, in pairs of blocks; only verified links count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, runs, slices
from .components import block_pairs, components, local_roots
from .tokens import mix, spans_hash, words

ROWS = 5
STEP = 16


def shingles(w, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `size` words, text after text, and where each text's begin. A shorter text has one: all its words."""
    n = np.diff(w.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.r_[0, np.cumsum(count)]
    lo = np.repeat(w.first[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    hi = np.minimum(lo + size, np.repeat(w.first[1:], count))
    return spans_hash(w.hash, lo, hi), first


def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Fewest matches of n MinHash values with which P(similarity >= threshold) >= tolerance, a uniform prior given.

    The posterior is Beta(a + 1, n - a + 1); its upper tail is a binomial sum.
    """
    for a in range(n + 1):
        if sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(a + 1)) >= tolerance:
            return a
    return n


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, hashes: int, seed: int) -> DataFrame:
    """(doc_id, k1, k2, cid, bands array<long>, sig binary): k1, k2 name the row's id and text, cid the text's words (null without words)."""
    gen = np.random.default_rng(seed)
    mul = gen.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    add = gen.integers(0, 2**63, hashes, dtype=np.uint64)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = words(b.column("text"))
                cid = spans_hash(w.hash, w.first[:-1], w.first[1:]).view(np.int64)
                sh, first = shingles(w, size)
                some = np.flatnonzero(np.diff(first))
                sig = np.zeros((b.num_rows, hashes), np.uint32)
                for k in range(hashes) if len(some) else ():
                    sig[some, k] = np.minimum.reduceat(((sh * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32), first[some])
                keys = np.zeros((b.num_rows, bands), np.uint64)
                for j in range(bands):
                    key = np.full(b.num_rows, np.uint64(j + 1))
                    for k in range(j * ROWS, (j + 1) * ROWS):
                        key = mix(key ^ sig[:, k])
                    keys[:, j] = key
                low = sig.astype(np.uint16)
                empty = np.diff(w.first) == 0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(cid, mask=empty), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))), pa.array([x.tobytes() for x in low], pa.binary())],
                    ["doc_id", "k1", "k2", "cid", "bands", "sig"],
                )

    src = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(go, f"doc_id {kind}, k1 long, k2 long, cid long, bands array<long>, sig binary")


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text: rows that agree in both have both in common."""
    i, t = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, i.isNull()).alias("k2")


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (i, j) are left after all steps of comparison."""
    alive, same = np.arange(len(i)), np.zeros(len(i), np.int32)
    for at in range(0, sig.shape[1], STEP):
        same = same + (sig[i[alive], at : at + STEP] == sig[j[alive], at : at + STEP]).sum(axis=1, dtype=np.int32)
        stay = same >= least[min(at + STEP, sig.shape[1])]
        alive, same = alive[stay], same[stay]
        if not len(alive):
            break
    return alive


def _bucket_edges(least: dict[int, int]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["key", "bi", "bj"]):
            cid, blk = t.column("cid").to_numpy(), t.column("blk").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(cid), -1)
            size = np.diff(at)
            two = at[:-1][size == 2]  # most buckets: all of a batch at once
            keep = two[_survivors(sig, two, two + 1, least)]
            a, b = [cid[keep]], [cid[keep + 1]]
            for lo, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
                i, j = np.triu_indices(n, 1)
                if t.column("bi")[lo].as_py() != t.column("bj")[lo].as_py():
                    cross = blk[lo + i] != blk[lo + j]
                    i, j = i[cross], j[cross]
                on = _survivors(sig[lo : lo + n], i, j, least)
                linked = np.zeros((n, n), bool)
                linked[i[on], j[on]] = linked[j[on], i[on]] = True
                own = cid[lo : lo + n]
                root = local_roots(linked, own)
                a.append(own[root != own])
                b.append(root[root != own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return go


def _dealt(rows: DataFrame, bucket: int) -> DataFrame:
    """(cid, key, blk, bi, bj) for the buckets of more than one member; those with the same members are kept once.

    A bucket of more than `bucket` members is dealt into blocks; each member goes to the pairs of its block with every
    block, so that any two members meet, in groups of two blocks at most.
    """
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("lead"), F.sum(F.shiftright(F.xxhash64("cid"), 16)).alias("mark")).where("n > 1")
    buckets = stats.groupBy("mark", "n", "lead").agg(F.min("key").alias("key"))
    out = rows.join(buckets.select("key", "n"), "key").withColumn("nb", F.ceil(F.col("n") / bucket).cast("int"))
    out = out.withColumn("blk", F.pmod(F.xxhash64("cid", "key"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return out.select("cid", "key", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"))


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float, bucket: int, hashes: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs that survive pruning, for each pair of blocks of each bucket."""
    dealt = _dealt(reps.select("cid", F.explode("bands").alias("key")), bucket)
    least = {n: least_matches(threshold, tolerance, n) for n in {*range(STEP, hashes, STEP), hashes}}
    full = dealt.join(reps.select("cid", "sig"), "cid").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return full.select("key", "bi", "bj", "blk", "cid", "sig").mapInArrow(_bucket_edges(least), "a long, b long")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets, left by right. Only values that several sets share are laid out, in slabs."""
    flat = np.concatenate([sets[i] for i in range(len(sets))]) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    slab = 4096
    ends = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + slab, slab))
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        m = np.zeros((len(sets), slab), np.float32)
        m[owner[lo:hi], col[lo:hi] - k * slab] = 1
        out += m[left] @ m[right].T
    return out


def _verified(threshold: float, size: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["component", "bi", "bj"]):
            cols = [t.column(c).to_numpy() for c in ("bi", "bj", "blk", "id", "weight")]
            a, b, n = [], [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                token = words(t.column("text").slice(lo, hi - lo).combine_chunks())
                own = spans_hash(token.hash, token.first[:-1], token.first[1:]).view(np.int64)
                once = np.flatnonzero(own == cols[3][lo:hi])  # not another text, or the same row again, of a repeated id
                once = once[np.unique(own[once], return_index=True)[1]]
                bi, bj, blk, ids, w = (c[lo:hi][once] for c in cols)
                sh, first = shingles(token, size)
                sets = [np.unique(sh[x:y]) for x, y in zip(first[once], first[once + 1], strict=True)]
                if not len(ids):
                    continue
                left, right = np.flatnonzero(blk == bi[0]), np.flatnonzero(blk == bj[0])
                if not len(left) or not len(right):
                    continue
                many = np.array([len(s) for s in sets], np.float64)
                inter = _overlaps(sets, left, right)
                linked = inter >= threshold * (many[left][:, None] + many[right][None, :] - inter) - 1e-9
                full = np.zeros((len(ids), len(ids)), bool)
                full[np.ix_(left, right)] = linked
                full |= full.T
                np.fill_diagonal(full, False)
                a.append(ids)
                b.append(local_roots(full, ids))
                n.append(full @ w)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b, n)], ["a", "b", "n"])

    return go


def _classified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, bands: int = 20, hashes: int = 128,
    tolerance: float = 1e-3, bucket: int = 256, block: int = 192, seed: int = 11,
) -> DataFrame:
    """(doc_id, k1, k2, cid, component, class_id, n_links) for each row of docs; component names the class."""
    sig = cut(signatures(docs, id_col, text_col, size, bands, hashes, seed))
    classes = sig.where("cid is not null").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("x"), F.count("*").alias("weight"))
    classes = classes.select("cid", F.col("x.doc_id").alias("rep"), F.col("x.k1").alias("r1"), F.col("x.k2").alias("r2"), "weight")
    picked = sig.where("cid is not null").join(classes, "cid").where("k1 = r1 and k2 = r2")
    reps = picked.dropDuplicates(["cid"]).select("cid", "bands", "sig")
    comp = components(candidate_edges(reps, threshold, tolerance, bucket, hashes))
    need = comp.withColumnRenamed("id", "cid").join(classes, "cid")
    texts = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text"))
    # rows may agree in id and text: _verified keeps one whose words have the class's hash
    members = need.join(texts, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2"))).select(F.col("cid").alias("id"), "component", "weight", "text")
    pairs = block_pairs(members, block).repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    found = cut(pairs.select("component", "bi", "bj", "blk", "id", "weight", "text").mapInArrow(_verified(threshold, size), "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    final = components(found.where("a != b")).withColumnRenamed("id", "cid")
    joined = classes.join(links, "cid", "left").join(final, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = joined.groupBy("component").agg(F.min("rep").alias("class_id"))
    by_class = joined.join(named, "component").select("cid", "component", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    full = sig.select("doc_id", "k1", "k2", "cid").join(by_class, "cid", "left")
    class_id = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return full.select("doc_id", "k1", "k2", "cid", "component", class_id.alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id reachable over links), n_links (rows linked directly), kept.

    Documents link where the sets of their five-word shingles have a Jaccard similarity of at least the threshold. Words
    are split at white space, A-Z lower-cased. A text of fewer words than a shingle has one shingle, all its words. Null
    and empty texts have none: they link with nothing and each is a class of its own. Rows repeated with one id are
    copies of each other (kept holds for each of them); null ids form classes by text as others do. Other columns are
    ignored. An empty table gives an empty result.
    """
    full = _classified(docs, id_col, text_col, **options)
    return full.select("doc_id", "class_id", "n_links", F.col("class_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay when each class keeps one: that of the smallest id (null ids last), all columns kept.

    Texts without words stay, every row. Different texts under one id are judged each by its own class; of rows with one
    id and one text the least by all their columns stays, which must be of kinds that can be ordered.
    """
    names = docs.columns
    full = _classified(docs, id_col, text_col, **options).where("cid is not null")
    pick = full.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("x")).select(F.col("x.k1").alias("_k1"), F.col("x.k2").alias("_k2"))
    k1, k2 = row_keys(id_col, text_col)
    wordy = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.where(wordy).select(k1.alias("_k1"), k2.alias("_k2"), *names)
    one = keyed.join(pick, ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.min(F.struct(*names)).alias("_r"))
    return one.select("_r.*").union(docs.where(~wordy).select(*names))
