"""Scoring texts by a probabilistic suffix tree over words.

Symbols are the training words, an end-of-text symbol, and one symbol that stands for every word not seen in training.
Every string of words that is seen `least` times is a candidate for a context; it stays if some next symbol is
significantly likelier after it than after its longest shorter suffix; it keeps those symbols and leaves the rest of its
mass to the suffix. A text is scored by the longest retained suffix at each place.

Counts, divergence tests and the tree itself are tables of any size: a level's strings are counted, joined to those of the
level before, and tested; blocks of documents are joined to the parts of the tree that they hold. Strings are named by
64-bit hashes. Bit maps of a bounded size keep strings out of a shuffle that cannot be in its result; where a map is full
they keep out less, and results stay the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, distinct, find, find_sorted, from_planes, planes, remove, runs, slices, stored, tidy
from .tokens import mix, sums, words

END = np.uint64(0x51ED270B0A1B2C3D)
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x27D4EB2F165667C5)
#: What a row of the model holds for its key: a word's count, the mass that a context leaves to its suffix, the mass of a symbol after a context.
WORD, CONTEXT, PAIR = (np.uint64(x) for x in (0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
MAP_BITS = 1 << 28
#: Bytes of text whose arrays are made at a time.
SLICE = 1 << 19


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end symbol after each text, and where each text's begin (and the end)."""
    w = words(column)
    n = len(w.first) - 1
    at = w.first + np.arange(n + 1)
    out = np.empty(len(w.hash) + n, np.uint64)
    end = at[1:] - 1
    inner = np.ones(len(out), bool)
    inner[end] = False
    out[inner] = w.hash
    out[end] = END
    return out, at


def follow(prefix: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """The names of strings that go on by a symbol."""
    return mix(prefix * _STEP ^ sym * _NEXT)


def strings_at(sym: np.ndarray, first: np.ndarray, longest: int) -> list[np.ndarray]:
    """For lengths 1..longest: the name of the string that ends at each place (0 where the text has not so many symbols before it)."""
    place = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
    out = [follow(np.zeros(len(sym), np.uint64), sym)]
    for k in range(1, longest):
        before = np.r_[np.zeros(1, np.uint64), out[-1][:-1]] if len(sym) else out[-1]
        out.append(np.where(place >= k, follow(before, sym), np.uint64(0)))
    return out


def _folded(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names in order, and the sums of their counts."""
    k, c = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
    return k[new], np.add.reduceat(c, new) if len(new) else c


def _packed(names_of, bits: int, most: int):
    """(bucket, names, counts): what a task counts, in order of the names, as bytes for each bucket of their first bits."""

    def rows(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        ends = np.r_[np.searchsorted(k, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(k)] if bits else np.array([len(k)])
        lo = np.r_[0, ends[:-1]]
        some = np.flatnonzero(ends > lo)
        cells = [[k[lo[i] : ends[i]].tobytes() for i in some], [c[lo[i] : ends[i]].tobytes() for i in some]]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *(pa.array(x, pa.binary()) for x in cells)], ["bucket", "names", "counts"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                got = names_of(b.column(0))
                names.append(got)
                counts.append(np.ones(len(got), np.int64))
                held += len(got)
                if held > most:
                    k, c = _folded(names, counts)
                    if len(k) > most // 2:
                        yield rows(k, c)
                        k, c = k[:0], c[:0]
                    names, counts, held = [k], [c], len(k)
        yield rows(*_folded(names, counts))

    return go


def counted(texts: DataFrame, names_of, expected: int, least: int = 1, bucket: int = 1_000_000, most: int = 1_000_000) -> DataFrame:
    """(name, n): names that occur `least` times or more in all texts; names_of gives those of a text column.

    Tasks send what they have counted as bytes, a row for each bucket of names, of which there is one for every `bucket`
    expected names; a task adds up one bucket at a time.
    """
    bits = max(0, math.ceil(math.log2(max(expected, 1) / bucket)))
    dealt = texts.mapInArrow(_packed(names_of, bits, most), "bucket long, names binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["bucket"]):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                cells = [[np.frombuffer(x.as_buffer(), kind) for x in t.column(c).slice(lo, hi - lo)] for c, kind in (("names", np.uint64), ("counts", np.int64))]
                k, c = _folded(*cells)
                on = np.flatnonzero(c >= least)
                for i in range(0, len(on), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[on[i : i + 65_536]].view(np.int64)) for x in (k, c)], ["name", "n"])

    return dealt.mapInArrow(add, "name long, n long")


def _dealt_grams(grams_of, bits: int, most: int):
    """(bucket, contexts, sizes, symbols, counts): strings (context, symbol) as a task counts them, for each bucket of the first
    bits of their names. In a bucket they are ordered by context, so that a context is written once, with the number of its rows."""
    top, low = np.uint64((1 << 64) - (1 << (64 - bits))), np.uint64((1 << 20) - 1)

    def folded(context: np.ndarray, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Most repeated rows made one (all of them in _add_grams), ordered by bucket and context."""
        name = follow(context, sym)
        order = np.argsort(name & top | context >> np.uint64(bits) & ~low | name & low)
        name = name[order]
        new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, int)
        at = order[new]
        return context[at], sym[at], np.add.reduceat(n[order], new) if len(new) else n, name[new]

    def rows(context: np.ndarray, sym: np.ndarray, n: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        ends = np.r_[np.searchsorted(name & top, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(name)] if bits else np.array([len(name)])
        cells: list[list] = [[], [], [], [], []]
        for i, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
            if hi > lo:
                own = context[lo:hi]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                for cell, x in zip(cells, (i, np.diff(own[first], prepend=np.uint64(0)), np.diff(np.r_[first, hi - lo]), sym[lo:hi], n[lo:hi]), strict=True):
                    cell.append(planes(x) if cell is not cells[0] else x)
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int64()), *(pa.array(x, pa.binary()) for x in cells[1:])], ["bucket", "contexts", "sizes", "symbols", "counts"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        held, size = [none], 0
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                context, sym = grams_of(b.column(0))
                held.append([context, sym, np.ones(len(sym), np.int64)])
                size += len(sym)
                if size > most:
                    got = folded(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    if len(got[0]) > most // 2:
                        yield rows(*got)
                        got = none
                    held, size = [got[:3]], len(got[0])
        yield rows(*folded(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return go


def _add_grams(least: int):
    """(name, context, symbol, n) of the strings that occur `least` times or more, one bucket at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["bucket"]):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                parts = []
                for row in zip(*(t.column(c).slice(lo, hi - lo) for c in ("contexts", "sizes", "symbols", "counts")), strict=True):
                    context, sizes, sym, n = (from_planes(x.as_buffer(), kind) for x, kind in zip(row, (np.uint64, np.int64, np.uint64, np.int64), strict=True))
                    parts.append((np.repeat(np.cumsum(context, dtype=np.uint64), sizes), sym, n))
                context, sym, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                name = follow(context, sym)
                order = np.argsort(name)
                name = name[order]
                new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                total = np.add.reduceat(n[order], new)
                on = np.flatnonzero(total >= least)
                first = order[new[on]]
                cols = [name[new[on]], context[first], sym[first], total[on]]
                for i in range(0, len(on), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65_536].view(np.int64)) for x in cols], ["name", "context", "symbol", "n"])

    return go


def followed(texts: DataFrame, grams_of, expected: int, least: int, bucket: int = 1_000_000, most: int = 1_000_000) -> DataFrame:
    """(name, context, symbol, n): strings that occur `least` times or more; grams_of gives contexts and symbols of a text column.
    Buckets are of the strings' names, so that what follows a frequent context lies in many."""
    bits = max(0, math.ceil(math.log2(max(expected, 1) / bucket)))
    dealt = texts.mapInArrow(_dealt_grams(grams_of, bits, most), "bucket long, contexts binary, sizes binary, symbols binary, counts binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_add_grams(least), "name long, context long, symbol long, n long")


class BitMap:
    """Which names a table has, as bits at their hashes: a name that is there is found, one that is not there seldom."""

    def __init__(self, names: DataFrame, col: str):
        n = names.count()
        self.bits = int(min(MAP_BITS, max(1 << 16, 1 << (32 * n).bit_length())))
        at = F.pmod(F.col(col), F.lit(self.bits))  # names are hashes
        cells = names.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({col}, 64) as int))")).alias("mask"))
        got = cells.toArrow()  # MAP_BITS / 64 rows at most
        self.cells = np.zeros(self.bits // 64, np.int64)
        self.cells[got.column("cell").to_numpy()] = got.column("mask").to_numpy()

    def has(self, names: np.ndarray) -> np.ndarray:
        at = names.view(np.int64) & (self.bits - 1)  # bits is a power of two
        return self.cells[at >> 6] >> (at & 63) & 1 == 1


@dataclass
class Tree:
    """total, types, unseen: symbols and kinds in training, and the mass of the unknown symbol. model (key, value): the counts
    of words and what is kept of contexts, by key; contexts and pairs: maps of the names that it has."""

    total: int
    types: int
    unseen: float
    depth: int
    model: DataFrame
    contexts: BitMap | None
    pairs: BitMap | None

    def keys(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The keys of the model that texts may ask for, each once."""
        at = strings_at(sym, first, self.depth + 1)
        out = [mix(distinct(sym) ^ WORD)]
        for k in range(1, self.depth + 1) if self.contexts else ():
            context = np.r_[np.zeros(1, np.uint64), at[k - 1][:-1]]
            on = (at[k] != 0) & self.contexts.has(context)
            out.append(mix(distinct(context[on]) ^ CONTEXT))
            pair = distinct(at[k][on])
            out.append(mix(pair[self.pairs.has(pair)] ^ PAIR))
        return distinct(np.concatenate(out))

    def log10(self, sym: np.ndarray, first: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol and its count in training (0: unknown), given the sorted keys that the texts ask for and what the model has for them (NaN: nothing)."""

        def value(names: np.ndarray, kind: np.uint64) -> np.ndarray:
            at = find_sorted(keys, mix(names ^ kind))
            return np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else np.nan, np.nan)

        counts = np.nan_to_num(value(sym, WORD))
        p = np.where(counts > 0, counts / max(self.total, 1) * (1 - self.unseen), self.unseen)
        at = strings_at(sym, first, self.depth + 1)
        for k in range(1, self.depth + 1) if self.contexts else ():
            context = np.r_[np.zeros(1, np.uint64), at[k - 1][:-1]]
            on = np.flatnonzero((at[k] != 0) & self.contexts.has(context))
            left = value(context[on], CONTEXT)
            on, left = on[~np.isnan(left)], left[~np.isnan(left)]
            p[on] = left * p[on] + np.nan_to_num(value(at[k][on], PAIR))
        return np.log10(p), counts.astype(np.int64)


def grow(train: DataFrame, counts: DataFrame, depth: int, least: int) -> Tree:
    """The tree of the training texts (text); counts: (name, n) of their symbols.

    Level by level: strings one symbol longer whose beginning and end were seen `least` times are counted, as contexts and what
    follows them; joined to the level before they know how often their context was seen and how likely its suffix makes the last symbol.
    """
    row = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one")).first()
    total, types = int(row.n or 0), int(row.v)
    key = lambda kind: lambda it: (pa.RecordBatch.from_arrays([pa.array(mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ kind).view(np.int64)), b.column(1)], ["key", "value"]) for b in it)
    model = counts.select("name", F.col("n").cast("double")).mapInArrow(key(WORD), "key long, value double")
    if not total:
        return Tree(0, 0, 1.0, depth, model, None, None)
    unseen = max(int(row.one), 1) / (total + 1)

    def level_zero(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sym, n = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            none = np.zeros(len(sym), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(follow(none, sym).view(np.int64)), pa.array(none.view(np.int64)), pa.array(n), pa.array(n / total * (1 - unseen))], ["name", "suffix", "n", "p"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffix of a string is what its context's suffix goes on to."""
        for b in batches:
            rest, sym = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("rest", "symbol"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("name", "context", "n", "size")), pa.array(follow(rest, sym).view(np.int64))], ["name", "context", "n", "size", "shorter"])

    # of each string seen often enough: its suffix, its count, and how likely the tree makes its last symbol
    level, level_at = stored(counts.where(F.col("n") >= least).mapInArrow(level_zero, "name long, suffix long, n long, p double"))
    kept_contexts, kept_pairs = None, None
    for k in range(1, depth + 1):
        often = BitMap(level, "name")

        def grams_of(column: pa.Array, k=k, often=often) -> tuple[np.ndarray, np.ndarray]:
            sym, first = symbols(column)
            at = strings_at(sym, first, k)[k - 1]
            seen = (at != 0) & often.has(at)
            on = seen.copy()
            on[1:] &= seen[:-1]
            on[first[:-1]] = False
            on = np.flatnonzero(on)
            return at[on - 1], sym[on]

        grams, grams_at = stored(followed(train, grams_of, total, least))
        tidy(train.sparkSession)
        sized = grams.join(level.select(F.col("name").alias("context"), F.col("n").alias("size"), F.col("suffix").alias("rest")), "context")
        named = sized.mapInArrow(suffixes, "name long, context long, n long, size long, shorter long")
        tested = named.join(level.select(F.col("name").alias("shorter"), F.col("p").alias("before")), "shorter")
        # the divergence that a symbol adds, as a Poisson log-likelihood ratio against the suffix
        expected = F.col("size") * F.col("before")
        gain = F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
        keeps = (F.col("n") > 1.2 * expected) & (gain >= 0.5 * F.log("size") + 3)
        tested, tested_at = stored(tested.select("name", "context", "shorter", "n", "before", F.when(keeps, (F.col("n") - 0.5) / F.col("size")).alias("add")))
        remove(grams_at)
        remove(level_at)
        contexts = cut(tested.where("add is not null").groupBy("context").agg((1 - F.sum("add")).alias("left")))
        pairs = cut(tested.where("add is not null").select("name", "add"))
        model = model.union(contexts.mapInArrow(key(CONTEXT), "key long, value double")).union(pairs.mapInArrow(key(PAIR), "key long, value double"))
        kept_contexts = contexts.select("context") if kept_contexts is None else kept_contexts.union(contexts.select("context"))
        kept_pairs = pairs.select("name") if kept_pairs is None else kept_pairs.union(pairs.select("name"))
        if k < depth:
            p = F.when(F.col("left").isNull(), F.col("before")).otherwise(F.col("left") * F.col("before") + F.coalesce("add", F.lit(0.0)))
            level, level_at = stored(tested.join(contexts, "context", "left").select("name", F.col("shorter").alias("suffix"), "n", p.alias("p")))
        remove(tested_at)
        tested = grams = sized = named = None
        tidy(train.sparkSession)
    return Tree(total, types, unseen, depth, model, BitMap(kept_contexts, "context"), BitMap(kept_pairs, "name"))


def _all_keys(tree: Tree, texts: pa.Table) -> np.ndarray:
    keys = [tree.keys(*symbols(b.column(0))) for b0 in texts.select(["text"]).to_batches() for b in slices(b0, "text", SLICE)]
    return distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _asked(tree: Tree, bits: int):
    """(bucket, block, data): the keys of a block of documents, in order, by buckets of their first bits."""

    def go(t: pa.Table) -> pa.Table:
        keys = _all_keys(tree, t)
        ends = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
        parts = np.split(keys, ends)
        some = [i for i, x in enumerate(parts) if len(x)]
        data = [planes(np.diff(parts[i], prepend=np.uint64(0))) for i in some]
        return pa.table({"bucket": pa.array(some, pa.int64()), "block": pa.array([t.column("block")[0].as_py() if t.num_rows else 0] * len(some), pa.int64()), "data": pa.array(data, pa.binary())})

    return go


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of bytes for each bucket of the model: its keys in order, then their values."""
    for t, at in runs(batches, ["bucket"]):
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            keys, values = (t.column(c).slice(lo, hi - lo).to_numpy() for c in ("key", "value"))
            keys = keys.view(np.uint64)
            order = np.argsort(keys)
            data = planes(np.diff(keys[order], prepend=np.uint64(0))) + planes(values[order])
            yield pa.RecordBatch.from_arrays([t.column("bucket").slice(lo, 1).combine_chunks(), pa.array([data], pa.binary())], ["bucket", "data"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, the model's first: for each block's keys of the bucket the values, NaN for those that the model lacks."""
    none = (np.zeros(0, np.uint64), np.zeros(0))
    bucket, model = None, none
    for b in batches:
        for i, (own, block) in enumerate(zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True)):
            if own != bucket:
                bucket, model = own, none
            data = b.column("data")[i].as_buffer()
            if block is None:
                half = data.size // 2
                model = (np.cumsum(from_planes(data.slice(0, half), np.uint64), dtype=np.uint64), from_planes(data.slice(half), np.float64))
                continue
            at = find(model[0], np.cumsum(from_planes(data, np.uint64), dtype=np.uint64))
            got = np.where(at >= 0, model[1][np.maximum(at, 0)], np.nan) if len(model[0]) else np.full(len(at), np.nan)
            yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), b.column("bucket").slice(i, 1), pa.array([planes(got)], pa.binary())], ["block", "bucket", "data"])


def _score(tree: Tree, id_type: pa.DataType):
    def go(docs: pa.Table, part: pa.Table) -> pa.Table:
        keys = _all_keys(tree, docs)
        order = np.argsort(part.column("bucket").to_numpy())
        answers = part.column("data").to_pylist()
        values = np.concatenate([from_planes(pa.py_buffer(answers[i]), np.float64) for i in order]) if len(order) else np.zeros(0)
        floor = tree.total + 1 * (tree.types + 1)
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for b0 in docs.select(["text"]).to_batches():
            for b in slices(b0, "text", SLICE):
                sym, first = symbols(b.column(0))
                log, c = tree.log10(sym, first, keys, values)
                cols[0].append(np.diff(first))
                cols[1].append(sums((c > 0).astype(np.int64), first))
                cols[2].append(sums(np.log10((c + 1) / floor), first))
                cols[3].append(sums(log, first))
        v = [np.concatenate(c) if c else np.zeros(0) for c in cols]
        return pa.table({
            "doc_id": docs.column("doc_id").cast(id_type), "held_out": docs.column("held_out"), "n_tokens": pa.array(v[0].astype(np.int64)), "n_known": pa.array(v[1].astype(np.int64)),
            "train_tokens": pa.array(np.full(docs.num_rows, tree.total, np.int64)), "base_score": pa.array(v[2].astype(float)), "score": pa.array(v[3].astype(float)),
        })

    return go


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least: int = 4, block_chars: int = 6_000_000, bucket: int = 100_000, parts: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id (as text) modulo 7 is not 2. Null texts are empty: one end symbol. base_score
    is the add-one unigram score; score sums log10 of the tree's probabilities over the same symbols, the unknown one
    among them. Repeated rows count and are scored each time. Other columns are ignored. An empty table gives an empty result.
    Documents are dealt into blocks of about block_chars characters, a task each, whatever their number; a block asks the
    model, which lies in buckets of about `bucket` rows, for the keys that it holds; one of at most `parts` parts of the blocks
    comes after the other, so that only a part's texts, keys and answers lie in a shuffle. The result is written.
    """
    from dataclasses import replace

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (crc_mod(id_col, 7) == 2).alias("held_out"))
    train = src.where("not held_out").select("text")
    chars = src.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    counts = cut(counted(train, lambda c: symbols(c)[0], chars // 4))
    tidy(spark)
    grown = grow(train, counts, depth, least)
    tree = replace(grown, model=None)  # what travels to the tasks
    bits = max(0, math.ceil(math.log2(max(grown.types, 1) / bucket)))
    first_bits = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    by_bucket = grown.model.select(first_bits.alias("bucket"), "key", "value").repartition("bucket").sortWithinPartitions("bucket")
    laid, laid_at = stored(by_bucket.mapInArrow(_laid, "bucket long, data binary"))
    grown = counts = by_bucket = None
    tidy(spark)
    blocks = max(1, math.ceil(chars / block_chars))
    parts = min(parts, math.ceil(blocks / 4))
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)))
    kind = src.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(own: int) -> DataFrame:
        dealt = src.where(F.col("block") % parts == own).repartition(math.ceil(blocks / parts), "block")
        asked = dealt.groupBy("block").applyInArrow(_asked(tree, bits), "bucket long, block long, data binary")
        both = laid.select("bucket", F.lit(None).cast("long").alias("block"), "data").union(asked.select("bucket", "block", "data"))
        part = both.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answered, "block long, bucket long, data binary")
        return cut(dealt.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(_score(tree, to_arrow_type(kind)), schema))

    out = None
    for own in range(parts):
        got = score(own)
        out = got if out is None else out.union(got)
        tidy(spark)
    remove(laid_at)
    return out
