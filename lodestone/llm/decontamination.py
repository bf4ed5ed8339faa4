"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified by edit distance on words.

The walk of a window notes a word at each step and moves on by a random bit that the step and the word decide, so that
near sequences have walks that agree in most places (edit distance becomes Hamming distance). A walk's first steps are
the same whatever the length of its window; one walk from each place of a text therefore serves items of every size. A
hash table samples a few early steps of one walk; an item's own places enter it with theirs. How many tables an item
needs follows from its length and permitted edits, for the recall asked for. Every pair of places that a table names is
verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import mix, words

#: (steps of the walk, sampled steps, least words passed): items take the longest that reaches the recall in MOST_TABLES.
FAMILIES = ((8, 7, 2), (5, 4, 1), (3, 3, 0), (1, 1, 0))
MOST_TABLES = 4


def allowed_edits(m: int, share: float) -> int:
    """Edits on words within which an item of m words counts as found: a share of m, but never all of them."""
    return max(0, min(math.floor(share * m + 1e-9), m - 1))


def sampled_steps(family: int, table: int, seed: int) -> np.ndarray:
    """The steps of the walk that a table looks at, in order."""
    steps, sample, _ = FAMILIES[family]
    return np.sort(np.random.default_rng([seed, family, table]).choice(steps, sample, replace=False))


def meeting(run: int, last: int, least: int) -> float:
    """Chance that a table names a pair of places inside `run` words without an edit.

    A walk has passed k words at step `last` with the binomial probability of k bits; from the i-th word of the run it
    stays inside if k < run - i. Walks over fewer than `least` words are left out of the tables.
    """
    pmf = [math.comb(last, k) / 2**last for k in range(last + 1)]
    miss = 1.0
    for i in range(run):
        miss *= 1 - sum(pmf[least : max(least, run - i)])
    return 1 - miss


def tables_for(m: int, edits: int, recall: float, seed: int) -> tuple[int, int]:
    """(family, tables) with which an item is named with at least the given probability, its edits spread evenly (the worst case)."""
    short, longer = divmod(m - edits, edits + 1)
    for family, (_, _, least) in enumerate(FAMILIES):
        miss = 1.0
        for table in range(MOST_TABLES if family < len(FAMILIES) - 1 else 1):
            last = int(sampled_steps(family, table, seed)[-1])
            miss *= (1 - meeting(short, last, least)) ** (edits + 1 - longer) * (1 - meeting(short + 1, last, least)) ** longer
            if miss <= 1 - recall:
                return family, table + 1
    return len(FAMILIES) - 1, 1  # single words: certain to meet where any word of the item is left


def walk_keys(sym: np.ndarray, end: np.ndarray, family: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's key for the walk from each place, and whether the walk stays before `end` and passes enough words."""
    steps, _, least = FAMILIES[family]
    bits = mix(sym ^ np.uint64((seed * 1_000_003 + family * 7919 + table * 104_729 + 1) & (2**64 - 1)))
    wanted = sampled_steps(family, table, seed)
    start = np.arange(len(sym))
    at, top = start.copy(), max(len(sym) - 1, 0)
    key = np.zeros(len(sym), np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for j in range(int(wanted[-1]) + 1):
        if j in wanted:
            key = key * odd + sym[at]
        if j < wanted[-1]:
            at = np.minimum(at + ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64), top)
    return mix(key), (at < end) & (at - start >= least)


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Edits that turn the item into the best fitting run of the text (free ends in the text), at most `most` + 1."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for k, x in enumerate(item, 1):
        diag = row[:-1] + (text != x)
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(diag, row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place  # insertions along the row
        if row.min() > most:
            return most + 1
    return int(row.min())


class _Table:
    """Sorted keys of the items' walks, with the items that have them and the places there."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, offset: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.offset = keys[order], owner[order], offset[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys & np.uint64((1 << 22) - 1)] = True

    def pairs(self, keys: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of the walks that meet."""
        at = np.flatnonzero(good & self.maybe[keys & np.uint64((1 << 22) - 1)])
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owner[pick], self.offset[pick]


class _Items:
    """The items in arrays: words, permitted edits, and the hash tables of their walks."""

    def __init__(self, ids: list[int], texts: list[str], share: float, recall: float, seed: int):
        w = words(pa.array(texts, pa.string()))
        self.ids, self.seqs, self.sorted, self.edits, self.seed = [], [], [], [], seed
        want: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(ids):
            seq = w.hash[w.first[i] : w.first[i + 1]]
            if not len(seq):
                continue
            e = allowed_edits(len(seq), share)
            family, tables = tables_for(len(seq), e, recall, seed)
            for t in range(tables):
                want.setdefault((family, t), []).append(len(self.ids))
            self.ids.append(key)
            self.seqs.append(seq)
            self.sorted.append(np.unique(seq))
            self.edits.append(e)
        rows: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {k: [self._entries(owners, *k)] for k, owners in sorted(want.items())}
        named = {int(o) for parts in rows.values() for _, owner, _ in parts for o in owner}
        rest = [o for o in range(len(self.ids)) if o not in named]  # short items all of whose walks leave them
        if rest:
            rows.setdefault((len(FAMILIES) - 1, 0), []).append(self._entries(rest, len(FAMILIES) - 1, 0))
        self.tables = {k: _Table(*(np.concatenate(x) for x in zip(*parts, strict=True))) for k, parts in rows.items()}

    def _entries(self, owners: list[int], family: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, item, place in the item) of the walks that stay inside their item."""
        seqs = [self.seqs[o] for o in owners]
        size = np.array([len(s) for s in seqs])
        first = np.cumsum(size) - size
        key, good = walk_keys(np.concatenate(seqs), np.repeat(first + size, size), family, table, self.seed)
        offset = np.arange(len(key)) - np.repeat(first, size)
        return key[good], np.repeat(owners, size)[good], offset[good]

    def starts(self, sym: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Places, in order, where a window with the item should begin, by (text, item)."""
        end = np.repeat(first[1:], np.diff(first))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for (family, t), table in self.tables.items():
            found.append(table.pairs(*walk_keys(sym, end, family, t, self.seed)))
        if not found:
            return {}
        pos, owner, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.searchsorted(first, pos, "right") - 1
        rows = np.unique(np.stack([doc, owner, pos - first[doc] - offset], axis=1), axis=0)
        new = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True]) if len(rows) else [0]
        return {(int(rows[a, 0]), int(rows[a, 1])): rows[a:b, 2] for a, b in zip(new[:-1], new[1:], strict=True)}

    def place(self, item: int, text: np.ndarray, starts: np.ndarray) -> int | None:
        """Where the text holds the item, None if no run near the starts is within the permitted edits."""
        seq, e = self.seqs[item], self.edits[item]
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > len(seq) + 2 * e) + 1):
            near = text[max(0, group[0] - e) : max(0, group[-1] + len(seq) + e)]
            # an item within e edits leaves all but e of its words: a cheap test without loss
            own = self.sorted[item]
            there = own[np.isin(own, near)]
            if np.isin(seq, there).sum() >= len(seq) - e:
                found = _begin(seq, text, group.tolist(), e)
                if found is not None:
                    return max(0, found)
        return None

    def search(self, column: pa.Array) -> list[list[tuple[int, int]]]:
        """For each text its (item, word where it begins), by item."""
        w = words(column)
        out: list[dict[int, int]] = [{} for _ in range(len(column))]
        for (doc, item), starts in self.starts(w.hash, w.first).items():
            s = self.place(item, w.hash[w.first[doc] : w.first[doc + 1]], starts)
            if s is not None:
                key = self.ids[item]
                out[doc][key] = min(s, out[doc].get(key, s))
        return [sorted(x.items()) for x in out]


def _begin(item: np.ndarray, text: np.ndarray, starts: list[int], e: int) -> int | None:
    """The first of the starts whose window holds the item, None if none does: one pass over the span of all, then over halves."""
    m = len(item)
    if edit_distance(item, text[max(0, starts[0] - e) : max(0, starts[-1] + m + e)], e) > e:
        return None
    if len(starts) == 1:
        return starts[0]
    half = len(starts) // 2
    found = _begin(item, text, starts[:half], e)
    return found if found is not None else _begin(item, text, starts[half:], e)


def _search(items: _Items, hits_only: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                hits = items.search(b.column("text"))
                lists = [pa.array([[x[k] for x in h] for h in hits], pa.list_(pa.int64())) for k in (0, 1)]
                got = pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c != "text"], *lists], [*[c for c in b.schema.names if c != "text"], "item_ids", "word_starts"])
                yield got.filter(pa.array([bool(h) for h in hits])) if hits_only else got

    return go


def _drop(items: _Items, text_col: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col):
                yield b.filter(pa.array([not h for h in items.search(b.column(text_col))], pa.bool_()))

    return go


def _parts(items: DataFrame, item_id: str, item_text: str, share: float, recall: float, part_chars: int, seed: int) -> list[_Items]:
    """The items with their tables, in parts of about part_chars characters: what a task holds at a time."""
    wanted = items.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).where("k is not null and t is not null").distinct()
    total = wanted.agg(F.sum(F.length("t")).alias("n")).first().n or 0
    parts = max(1, math.ceil(total / part_chars))
    out = []
    for p in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == p).orderBy("k", "t").collect()  # about part_chars characters
        out.append(_Items([r.k for r in rows], [r.t for r in rows], share, recall, seed))
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with two hashes of the text: rows of equal texts have equal answers."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_k1", F.xxhash64(whole)).withColumn("_k2", F.xxhash64(whole, F.lit(1)))


def _hits(docs: DataFrame, text: str, models: list[_Items]) -> DataFrame:
    """(_k1, _k2, item_ids, word_starts): one row for each different text that holds an item of any part. A reading of the texts for each part."""
    src = _keyed(docs.select(F.col(text).alias("text")), "text")
    schema = "_k1 long, _k2 long, item_ids array<bigint>, word_starts array<bigint>"
    found = None
    for model in models:
        one = src.mapInArrow(_search(model, True), schema).dropDuplicates(["_k1", "_k2"])
        found = one if found is None else found.union(one)
    pairs = found.select("_k1", "_k2", F.explode(F.arrays_zip("item_ids", "word_starts")).alias("x"))
    best = pairs.groupBy("_k1", "_k2", F.col("x.item_ids").alias("i")).agg(F.min("x.word_starts").alias("s"))
    lists = best.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("x"))
    return lists.select("_k1", "_k2", F.col("x.i").alias("item_ids"), F.col("x.s").alias("word_starts"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = 0.15, recall: float = 0.99, part_chars: int = 4 << 20, seed: int = 5,
) -> DataFrame:
    """(doc_id, item_ids, word_starts): for each row of docs the items that it holds, and the word where each begins.

    An item is held if a run of the text's words is within a share of its words of edits (word by word, A-Z lower-cased);
    items of fewer words than 1 / share have to be there as they are. An item with the most edits, evenly spread, is found
    with probability `recall` at least, one with fewer edits or uneven ones more surely, one without edits always.
    Items with a null id or no word are not searched for; of several texts under one id any counts. Null and empty texts
    hold nothing. Repeated rows and null ids are rows of their own; other columns are ignored; no items: empty lists.
    The items travel to the tasks in parts of about part_chars characters (a longer item is a part). With several parts
    the texts are read once for each, and the lists are joined to the rows by a hash of the text.
    """
    models = _parts(items, item_id, item_text, share, recall, part_chars, seed)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(models) == 1:
        return src.mapInArrow(_search(models[0], False), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_ids array<bigint>, word_starts array<bigint>")
    none = F.array().cast("array<bigint>")
    full = _keyed(src, "text").drop("text").join(_hits(src, "text", models), ["_k1", "_k2"], "left")
    return full.select("doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("word_starts", none).alias("word_starts"))


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = 0.15, recall: float = 0.99, part_chars: int = 4 << 20, seed: int = 5,
) -> DataFrame:
    """The rows of docs that hold no item (see contamination), all columns kept; with one part of items in a single pass without a join."""
    models = _parts(items, item_id, item_text, share, recall, part_chars, seed)
    if len(models) == 1:
        return docs.mapInArrow(_drop(models[0], text_col), docs.schema)
    hits = _hits(docs, text_col, models)
    k1, k2 = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(1))
    return docs.join(hits.select("_k1", "_k2"), (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left_anti")
