"""Quality by the perplexity of an interpolated modified Kneser-Ney model, trained on trusted text.

Symbols are words (A-Z as a-z), between two edges before a text and one after it; n-grams are of order three. All trusted
texts are counted, whatever their number. What the model holds are counts: of each n-gram how often it is seen (of a pair
and a word: after how many words), and of each context how many n-grams continue it, by how often. They lie in files by
buckets of keys. Blocks of documents ask the buckets for the n-grams that they hold, and the probabilities are made
of the counts where the documents are. A document's perplexity is held against a quantile of the trusted texts in its language.

Training goes in passes over classes of middle words and scoring in parts of the documents, of a fixed number each, so
that only a part of the n-grams lies in a shuffle at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, distinct, filesystem, find, from_planes, planes, remove, runs, shared_dir, slices, tidy
from .tokens import mix, words

EDGE = np.uint64(0x2545F4914F6CDD1D)
_SALT = {name: np.uint64(x) for name, x in (("word", 0x9E3779B97F4A7C15), ("pair", 0xC2B2AE3D27D4EB4F), ("triple", 0x165667B19E3779F9))}
#: Tables of the model: counts of triples; of pairs and words; what continues pairs and words. Parts of the last two and of words, still to be added up, have no place yet.
TRIPLE, OWN, NEXT, WORDS = range(4)
NOWHERE = -1
#: Bytes of text whose arrays are made at a time.
SLICE = 1 << 19
_STORED = "bucket long, data binary, kind int, at long"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def word_key(x: np.ndarray) -> np.ndarray:
    return mix(x ^ _SALT["word"])


def pair_key(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(_join(v, x) ^ _SALT["pair"])


def triple_key(u: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(_join(u, _join(v, x)) ^ _SALT["triple"])


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with their edges; the places of those that are scored; where each text's scored ones begin (and the end)."""
    w = words(column)
    size = np.diff(w.first) + 3  # two edges, the words, an edge
    start = np.r_[0, np.cumsum(size)]
    sym = np.full(start[-1], EDGE, np.uint64)
    sym[np.repeat(start[:-1] + 2 - w.first[:-1], np.diff(w.first)) + np.arange(len(w.hash))] = w.hash
    at = np.ones(start[-1], bool)
    at[start[:-1]] = at[start[:-1] + 1] = False
    return sym, np.flatnonzero(at), np.r_[0, np.cumsum(size - 2)]


def packed(columns: list[np.ndarray]) -> bytes:
    return b"".join(planes(np.ascontiguousarray(c, np.uint64)) for c in columns)


def unpacked(data: pa.Buffer | bytes, width: int) -> list[np.ndarray]:
    data = memoryview(data)
    size = len(data) // width
    return [from_planes(data[i * size : (i + 1) * size], np.uint64) for i in range(width)]


def folded(keys: np.ndarray, same: list[np.ndarray], added: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, with what rows of a key have in common, and the sums of the rest."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[new], [c[order[new]] for c in same], [np.add.reduceat(c[order], new) if len(new) else c for c in added]


def _by_bucket(keys: np.ndarray, columns: list[np.ndarray], bits: int, kind: int, differences: bool, placed: bool) -> pa.RecordBatch:
    """Rows (bucket, data, kind, at) for sorted keys; with differences the keys themselves are the first column."""
    ends = np.r_[np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)] if bits else np.array([len(keys)])
    lo = np.r_[0, ends[:-1]]
    some = np.flatnonzero(ends > lo)
    cells = [packed(([np.diff(keys[lo[i] : ends[i]], prepend=np.uint64(0))] if differences else []) + [c[lo[i] : ends[i]] for c in columns]) for i in some]
    at = some if placed else np.full(len(some), NOWHERE)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(cells, pa.binary()), pa.array(np.full(len(some), kind, np.int32)), pa.array(at.astype(np.int64))], ["bucket", "data", "kind", "at"])


class _Held:
    """Rows of a task by key, added up when there are many of them."""

    def __init__(self, alike: int, summed: int, key: Callable, out: Callable, most: int):
        self.alike, self.key, self.out, self.most = alike, key, out, most
        self.rows, self.size, self.width = [], 0, alike + summed

    def put(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.rows.append([c.astype(np.uint64, copy=False) for c in columns])
        self.size += len(columns[0])
        if self.size > self.most:
            keys, cols = self.total()
            if len(keys) > self.most // 2:
                yield self.out(keys, cols)
                cols = [c[:0] for c in cols]
            self.rows, self.size = [cols], len(cols[0])

    def total(self) -> tuple[np.ndarray, list[np.ndarray]]:
        cols = [np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0, np.uint64) for i in range(self.width)]
        keys, same, added = folded(self.key(*cols[: self.alike]), cols[: self.alike], cols[self.alike :])
        return keys, same + added

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self.out(*self.total())
        self.rows, self.size = [], 0


def _places(own: int, passes: int, bits: int, most: int):
    """Triples whose middle word is of the class `own`, with their numbers as far as a task sees, in buckets of their keys."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(3, 1, triple_key, lambda k, c: _by_bucket(k, c, bits, TRIPLE, False, True), most)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                sym, at, _ = symbols(b.column(0))
                if passes > 1:
                    at = at[mix(sym[at - 1]) % np.uint64(passes) == own]
                yield from held.put([sym[at - 2], sym[at - 1], sym[at], np.ones(len(at), np.uint64)])
        yield from held.rest()

    return go


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[pa.Buffer]]]]:
    """For rows sorted by bucket: the data of each, by kind."""
    for t, at in runs(batches, ["bucket"]):
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            out: dict[int, list] = {}
            for kind, data in zip(t.column("kind").slice(lo, hi - lo).to_pylist(), t.column("data").slice(lo, hi - lo), strict=True):
                out.setdefault(kind, []).append(data.as_buffer())
            yield t.column("bucket")[int(lo)].as_py(), out


def _columns(cells: list[pa.Buffer], width: int) -> list[np.ndarray]:
    got = [unpacked(c, width) for c in cells]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.uint64) for i in range(width)]


def _keyed(cells: list[pa.Buffer], width: int) -> list[np.ndarray]:
    """The same where the first column has the differences of keys."""
    got = [unpacked(c, width) for c in cells]
    return [np.concatenate([np.cumsum(g[i], dtype=np.uint64) if i == 0 else g[i] for g in got]) if got else np.zeros(0, np.uint64) for i in range(width)]


def _by_size(n: np.ndarray) -> list[np.ndarray]:
    """Sum, and the numbers of those that are one, two, and more."""
    return [n, n == 1, n == 2, n > 2]


def _count_triples(bits: int, most: int):
    """Of each bucket the triples' counts; and parts of what they add to pairs (v, x) and contexts (u, v)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Held(2, 1, pair_key, lambda k, c: _by_bucket(k, c, bits, OWN, False, False), most)
        contexts = _Held(1, 4, lambda k: k, lambda k, c: _by_bucket(k, c[1:], bits, NEXT, True, False), most)
        for _, cells in _buckets(batches):
            u, v, x, n = _columns(cells[TRIPLE], 4)
            keys, (u, v, x), (n,) = folded(triple_key(u, v, x), [u, v, x], [n])
            yield _by_bucket(keys, [n], bits, TRIPLE, True, True)
            yield from pairs.put([v, x, np.ones(len(n), np.uint64)])
            yield from contexts.put([pair_key(u, v), *_by_size(n)])
        yield from pairs.rest()
        yield from contexts.rest()

    return go


def _count_pairs(bits: int, most: int):
    """Of each bucket the counts of pairs and what continues contexts; and parts of what pairs add to their words."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(1, 5, lambda k: k, lambda k, c: _by_bucket(k, c[1:], bits, WORDS, True, False), most)
        for _, cells in _buckets(batches):
            v, x, n = _columns(cells.get(OWN, []), 3)
            keys, (v, x), (n,) = folded(pair_key(v, x), [v, x], [n])
            yield _by_bucket(keys, [n], bits, OWN, True, True)
            context, *rest = _keyed(cells.get(NEXT, []), 5)
            context, _, rest = folded(context, [], rest)
            yield _by_bucket(context, rest, bits, NEXT, True, True)
            none = np.zeros(len(n), np.uint64)
            yield from held.put([word_key(x), none + np.uint64(1), none, none, none, none])
            yield from held.put([word_key(v), none, *_by_size(n)])
        yield from held.rest()

    return go


def _add_words(bits: int):
    """Parts of words, added up: parts again, one for each bucket."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in _buckets(batches):
            keys, *rest = _keyed(cells[WORDS], 6)
            keys, _, rest = folded(keys, [], rest)
            yield _by_bucket(keys, rest, bits, WORDS, True, False)

    return go


def _count_words(bits: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in _buckets(batches):
            keys, *rest = _keyed(cells[WORDS], 6)
            keys, _, rest = folded(keys, [], rest)
            for on, kind, cols in ((rest[0] > 0, OWN, rest[:1]), (rest[1] > 0, NEXT, rest[1:])):
                yield _by_bucket(keys[on], [c[on] for c in cols], bits, kind, True, True)

    return go


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row of counts: how many there are, their sum, and how many are one to four."""
    for b in batches:
        counts = [unpacked(x.as_buffer(), 2)[1] for x in b.column("data")]
        rows = [[len(n), int(n.sum()), *(int((n == i).sum()) for i in (1, 2, 3, 4))] for n in counts]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["kinds", "total", "n1", "n2", "n3", "n4"])


@dataclass(frozen=True)
class Model:
    """Folder of the counts, whose buckets are the first `bits` bits of keys; passes: its sub-folders. rows: how many n-grams there are.
    discounts: of words, pairs and triples, what is taken from a count of one, two, and more. words: the sum of the words' counts;
    rest: the probability that each word gets of what is left of them."""

    folder: str
    bits: int
    passes: int
    rows: int
    discounts: tuple[tuple[float, float, float], ...]
    words: int
    rest: float

    def table(self, kind: int, bucket: int) -> list[np.ndarray]:
        """Sorted keys of a bucket with their counts."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = filesystem(self.folder)
        parts = [f"triples-{i}" for i in range(self.passes)] if kind == TRIPLE else [*(f"pairs-{i}" for i in range(self.passes)), "words"]
        cells = []
        for part in parts:
            found = system.get_file_info(fs.FileSelector(f"{root}/{part}/kind={kind}/at={bucket}", allow_not_found=True))
            for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
                with system.open_input_file(path) as file:
                    cells += [x.as_buffer() for x in pq.ParquetFile(file).read(columns=["data"]).column(0)]
        cols = _keyed(cells, 5 if kind == NEXT else 2)
        order = np.argsort(cols[0], kind="stable")  # runs in order, one of each pass
        return [c[order] for c in cols]

    def cut(self, level: int, n: np.ndarray) -> np.ndarray:
        """What the discount leaves of counts."""
        return np.where(n > 0, n - np.array([0.0, *self.discounts[level]])[np.minimum(n, 3).astype(int)], 0.0)

    def left(self, level: int, following: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of what continues contexts (1 where nothing does), and the share of it that is left to shorter ones."""
        total, *few = following
        taken = sum(d * n for d, n in zip(self.discounts[level], few, strict=True))
        some = np.maximum(total, 1).astype(float)
        return some, np.where(total > 0, taken / some, 1.0)


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(folder)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.select("bucket", "data", "kind", "at").repartition("bucket").sortWithinPartitions("bucket")


def _write(rows: DataFrame, folder: str) -> None:
    """Whole buckets lie in folders of their own, which are asked for one by one."""
    rows.write.partitionBy("kind", "at").parquet(folder, compression="zstd")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Three constants from the numbers of n-grams that are counted one to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3))


def train(trusted: DataFrame, text_col: str = "text", shard_rows: int = 1_000_000, passes: int | None = None, most: int = 1_000_000) -> tuple[Model, float]:
    """The model of all texts, and the log10 probability of a word that was not seen. Small tables take one pass, large ones eight.

    Triples are counted in buckets of about shard_rows of their keys; what they add to pairs and contexts goes on to buckets of those, and
    what pairs add to words to buckets of words. A task sends what it has added up, so a frequent pair or word is a row for each task;
    those of words are added up after every second pass."""
    spark = trusted.sparkSession
    src = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = src.agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars")).first()
    places = size.texts + (size.chars or 0) // 6
    bits = max(0, math.ceil(math.log2(max(places, 1) / shard_rows)))
    passes = passes or max(1, min(8, places // 1_500_000))
    folder = f"{shared_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    system, root = filesystem(folder)
    held: list[str] = []  # folders with parts of words

    def words_to(name: str, go: Callable) -> None:
        _write(_dealt(_union([_read(spark, f"{folder}/{part}").where(F.col("kind") == WORDS) for part in held])).mapInArrow(go, _STORED), f"{folder}/{name}")
        tidy(spark)
        for part in held:
            system.delete_dir_contents(f"{root}/{part}/kind={WORDS}", missing_dir_ok=True)
        held[:] = [name]

    for own in range(passes):
        triples, pairs = f"{folder}/triples-{own}", f"{folder}/pairs-{own}"
        _write(_dealt(src.mapInArrow(_places(own, passes, bits, most), _STORED)).mapInArrow(_count_triples(bits, most), _STORED), triples)
        tidy(spark)
        _write(_dealt(_read(spark, triples).where(F.col("at") == NOWHERE)).mapInArrow(_count_pairs(bits, most), _STORED), pairs)
        tidy(spark)
        for kind in (OWN, NEXT):  # added up in pairs
            system.delete_dir_contents(f"{root}/triples-{own}/kind={kind}", missing_dir_ok=True)
        held.append(f"pairs-{own}")
        if own % 2 and own < passes - 1:
            words_to(f"parts-{own}", _add_words(bits))
    words_to("words", _count_words(bits))
    levels = [[_read(spark, f"{folder}/words").where(F.col("kind") == OWN)]]
    levels += [[_read(spark, f"{folder}/{part}-{own}").where(F.col("kind") == kind) for own in range(passes)] for part, kind in (("pairs", OWN), ("triples", TRIPLE))]
    names = ("kinds", "total", "n1", "n2", "n3", "n4")
    numbers = [
        [x or 0 for x in _union(level).select("data").mapInArrow(_numbers, ", ".join(f"{c} long" for c in names)).agg(*[F.sum(c) for c in names]).first()]
        for level in levels
    ]
    discounts = tuple(_discounts(n[2:]) for n in numbers)
    kinds, total, one, two, *_ = numbers[0]
    left = sum(d * n for d, n in zip(discounts[0], (one, two, kinds - one - two), strict=True))
    rest = left / total / (kinds + 1) if total else 1.0  # all kinds and the unknown one share what is left
    return Model(folder, bits, passes, sum(n[0] for n in numbers), discounts, max(total, 1), rest), math.log10(rest)


def _symbols_of(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts of a block, the places of scored ones, and the numbers of scored ones in each text."""
    cells, at, size, n = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)], 0
    for batch in texts.select(["text"]).to_batches():
        for b in slices(batch, "text", SLICE):
            sym, own, first = symbols(b.column(0))
            cells.append(sym)
            at.append(own + n)
            size.append(np.diff(first))
            n += len(sym)
    return np.concatenate(cells), np.concatenate(at), np.concatenate(size)


def keys_of(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a block's triples, and of its pairs and words."""
    sym, at, _ = _symbols_of(texts)
    return distinct(triple_key(sym[at - 2], sym[at - 1], sym[at])), distinct(np.concatenate([pair_key(sym[:-1], sym[1:]), word_key(sym)]))


class Grams:
    """The n-grams of a block of texts: size has the number of each text's scored symbols; `at` has for each scored symbol the
    places of its triple, of its pair, of the pair before it, of its word and of the word before it among the keys of keys_of."""

    def __init__(self, texts: pa.Table):
        sym, at, self.size = _symbols_of(texts)
        triple = self._placed(triple_key(sym[at - 2], sym[at - 1], sym[at]))
        n = max(len(sym) - 1, 0)
        place = self._placed(np.concatenate([pair_key(sym[:-1], sym[1:]), word_key(sym)]))
        self.at = (triple, place[at - 1], place[at - 2], place[n + at], place[n + at - 1])  # at 0 the pair that ends at 1

    @staticmethod
    def _placed(keys: np.ndarray) -> np.ndarray:
        """The place of each key among the distinct ones in their order."""
        order = np.argsort(keys)
        keys = keys[order]
        number = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1 if len(keys) else np.zeros(0, int)
        out = np.empty(len(order), int)
        out[order] = number
        return out


def _asked(bits: int):
    """(bucket, block, data): keys of a block of documents by buckets of their first bits, those of triples in even buckets."""

    def go(t: pa.Table) -> pa.Table:
        buckets, data = [], []
        for odd, keys in enumerate(keys_of(t)):
            ends = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
            for i, own in enumerate(np.split(keys, ends)):
                if len(own):
                    buckets.append(2 * i + odd)
                    data.append(packed([np.diff(own, prepend=np.uint64(0))]))
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "block": pa.array([t.column("block")[0].as_py() if t.num_rows else 0] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    return go


def _answered(model: Model, bits: int):
    """What the model has for the keys that blocks ask of a bucket: counts of triples; of pairs and words their counts and what continues them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tables = None, []
        for b in batches:
            for i, own in enumerate(b.column("bucket").to_pylist()):
                if own != bucket:
                    bucket = own
                    tables = [model.table(kind, (own >> 1) >> (bits - model.bits)) for kind in ((OWN, NEXT) if own & 1 else (TRIPLE,))]
                asked = np.cumsum(unpacked(b.column("data")[i].as_buffer(), 1)[0], dtype=np.uint64)
                out = []
                for keys, *counts in tables:
                    at = find(keys, asked)
                    out += [np.where(at >= 0, c[at], np.uint64(0)) if len(c) else np.zeros(len(asked), np.uint64) for c in counts]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), b.column("bucket").slice(i, 1), pa.array([packed(out)], pa.binary())], ["block", "bucket", "data"])

    return go


def _score(model: Model, id_type: pa.DataType):
    def go(docs: pa.Table, part: pa.Table) -> pa.Table:
        g = Grams(docs)
        rows = sorted(zip(part.column("bucket").to_pylist(), range(part.num_rows), strict=True))
        cells = [[part.column("data")[i].as_buffer() for b, i in rows if b % 2 == odd] for odd in (0, 1)]
        (n3,), (n, *following) = _columns(cells[0], 1), _columns(cells[1], 5)
        triple, pair, context, word, before = g.at
        p = model.cut(0, n[word]) / model.words + model.rest
        for level, own, by in ((1, n[pair], before), (2, n3[triple], context)):
            total, left = model.left(level, [c[by] for c in following])
            p = model.cut(level, own) / total + left * p
        ends = np.cumsum(g.size)
        logp = np.add.reduceat(np.log10(p), ends - g.size) if len(ends) else np.zeros(0)
        return pa.table({"doc_id": docs.column("doc_id").cast(id_type), "lang": docs.column("lang").cast(pa.string()), "n": pa.array(g.size.astype(np.int64)), "logp": pa.array(logp)})

    return go


def document_scores(
    docs: DataFrame, model: Model, unknown: float, id_col: str, text_col: str, lang_col: str, shard_rows: int = 1_000_000, block_chars: int = 5_000_000, parts: int = 10
) -> DataFrame:
    """(doc_id, lang, n, logp), a row for each row of docs, written. Documents are dealt into blocks of about block_chars characters, which ask
    for their n-grams in buckets of at most about shard_rows of the model's; one of at most `parts` parts of the blocks comes after the other."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType
    blocks = max(1, math.ceil((src.agg(F.sum(F.length("text")).alias("n")).first().n or 0) / block_chars))
    parts = min(parts, math.ceil(blocks / 4))
    bits = max(model.bits, math.ceil(math.log2(max(model.rows, 1) / shard_rows)))
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)))

    def score(own: int) -> DataFrame:
        dealt = src.where(F.col("block") % parts == own).repartition(math.ceil(blocks / parts), "block")
        asked = dealt.groupBy("block").applyInArrow(_asked(bits), "bucket long, block long, data binary")
        part = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answered(model, bits), "block long, bucket long, data binary")
        return cut(dealt.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(_score(model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, lang string, n long, logp double"))

    out = []
    for own in range(parts):
        out.append(score(own))
        tidy(docs.sparkSession)  # of a part nothing stays but its sums
    return _union(out)


def quality(
    docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.995, slack: float = 1.05, prior_words: int = 10, held_of: int = 5, shard_rows: int = 1_000_000,
) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_symbols, perplexity, threshold, kept.

    All documents that trusted_ids (doc_id) names are used: one of held_of, by a hash of the id, is held out, and the model
    is trained on the others.
    perplexity is per symbol, drawn toward the held-out mean as if prior_words more symbols had been read, so that short
    texts are not judged by chance; an empty or null text is one edge symbol. A language's threshold is the quantile of
    its held-out texts (ties: the greatest value at or below it, by percentile_approx) times the slack; languages without
    one, and null, have that of all. Without any held-out text every document is kept and its threshold null. Rows that repeat an id are judged each. Other columns are ignored.
    """
    docs = docs.select(id_col, text_col, lang_col)
    named = trusted_ids.select(F.col("doc_id").alias("_k")).where("_k is not null").distinct()
    held = F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(held_of)) == 0
    folder = f"{shared_dir(docs.sparkSession)}/trusted-{uuid.uuid4().hex}"
    trusted = docs.join(named.where(~held), F.col(id_col) == F.col("_k"), "left_semi").select(F.col(text_col).alias("text"))
    trusted.write.parquet(folder, compression="zstd")
    tidy(docs.sparkSession)
    model, unknown = train(docs.sparkSession.read.schema("text string").parquet(folder), "text", shard_rows)
    remove(folder)
    scored = document_scores(docs, model, unknown, id_col, text_col, lang_col, shard_rows)
    remove(model.folder)
    own = scored.join(named.where(held), F.col("doc_id") == F.col("_k"), "left_semi")
    mean = own.agg((F.sum("logp") / F.sum("n")).alias("m")).first().m
    base = F.lit(float(mean if mean is not None else 0.0))
    pp = F.pow(F.lit(10.0), -(F.col("logp") + prior_words * base) / (F.col("n") + prior_words))
    scored = scored.withColumn("perplexity", pp)
    own = cut(own.select("lang", pp.alias("perplexity")))
    by_lang = own.where("lang is not null").groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("t"))
    everywhere = own.agg((F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("t0"))
    # a row for each language, a few hundred; the documents stay where they are, however many share a language
    out = scored.join(F.broadcast(by_lang), "lang", "left").crossJoin(F.broadcast(everywhere)).withColumn("threshold", F.coalesce("t", "t0"))
    return out.select("doc_id", "lang", F.col("n").alias("n_symbols"), "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
