"""How two tokenizers cut the same texts: groups of tokens between common byte offsets, and corpus-wide counts of linked ids.

A map from each id of A to the id of B with the same bytes is computed once. A group of one token on either side that the
map explains is counted in a vector as long as A's vocabulary; only the other groups' links become rows of a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, shared_dir, slices, strings

SIDE = 1 << 31  # a pair of ids is a * SIDE + b


def byte_alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 characters for themselves, the rest in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: Fixed value: how a byte-level tokenizer cuts a text into words. Texts within these characters may take the quick encoder.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BEYOND = re.compile("[\u0530-\U0010ffff]")


def same_by_ranks(path: str) -> bool:
    """Whether merging by the rank of the merged bytes, as the quick encoder does, gives what the file's own merges give.

    It does if identifiers follow the merges and every entry, encoded alone by the merges, is one token: then no two tokens
    ever stand side by side whose bytes are an entry that is not made of these two. Word borders are tried on every
    character that the quick encoder is used for.
    """
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut_by = told["model"], told.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    plain = model["type"] == "BPE" and not told.get("normalizer") and cut_by.get("type") == "ByteLevel" and cut_by.get("use_regex", True) and not cut_by.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    ids = [vocab.get(l + r, -1) for l, r in merges]
    special = {t["content"] for t in told.get("added_tokens", [])}
    if ids != sorted(set(ids)) or (ids and ids[0] < 256) or any(c not in vocab for c in byte_alphabet()):
        return False
    bare = Tokenizer(models.BPE(vocab, merges))
    entries = [e for e in vocab if e not in special]
    if any(len(x.ids) != 1 for x in bare.encode_batch(entries)):
        return False
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    tried = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2.{chr(c)}. {chr(c)}" for c in range(0x530)]
    quick = _quick(path)
    return [x.ids for x in own.encode_batch(tried, add_special_tokens=False)] == [quick.encode_ordinary(t) for t in tried]


def _quick(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    alphabet, special = byte_alphabet(), {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in entry): i for entry, i in told["model"]["vocab"].items() if entry not in special}
    return tiktoken.Encoding("aligned", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers, the bytes of their entries, and the map between ids of the same bytes (-1: none). quick: same_by_ranks."""

    def __init__(self, a_path: str, b_path: str, quick: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores out
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.quick = _quick(a_path) if quick else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        plain = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.same = np.array([plain.get(x, -1) for x in self.a_bytes], np.int64)
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width, self.shown = most, [f"{i}{s}" for s in (",", "|", ";", "") for i in range(most)]

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        return [self.quick.encode_ordinary(t) if t.isascii() or not BEYOND.search(t) else self.a.encode(t, add_special_tokens=False).ids for t in texts]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none on either side for empty texts and those that a side does not give back byte for byte."""
        a = self._encode_a([" " + t for t in texts])
        b = self.b.encode(texts, out_type=int, num_threads=1)
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[k])) != whole or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, groups_sha256, and of each text the linked ids and how often: same, same_n, pair, pair_n."""
        a, b = self.encode(texts)
        n = len(texts)
        na, nb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        fa, fb = (np.fromiter(chain.from_iterable(side), np.int64, int(m.sum())) for side, m in ((a, na), (b, nb)))
        ea, eb = np.cumsum(self.a_size[fa]), np.cumsum(self.b_size[fb])  # of both sides the same bytes, text after text
        ends_a, ends_b = (np.zeros(int(ea[-1]) + 1 if len(ea) else 0, bool) for _ in range(2))
        ends_a[ea], ends_b[eb] = True, True
        at_a, at_b = np.flatnonzero(ends_b[ea]), np.flatnonzero(ends_a[eb])  # where both sides end
        ga, gb = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        doc = np.repeat(np.arange(n), na)[at_a]
        groups = np.bincount(doc, minlength=n).astype(np.int64)
        la, lb = fa[at_a], fb[at_b]  # the tokens of a group that end together are its last ones
        plain = (ga == 1) & (gb == 1) & (self.same[la] == lb)

        # every text's groups in order: where each token's number stands, and what follows it
        code = np.empty(len(fa) + len(fb), np.int64)
        after_a, after_b = np.zeros(len(fa), np.int64), np.zeros(len(fb), np.int64)
        after_a[at_a], after_b[at_b] = 1, 2
        after_b[np.cumsum(nb)[nb > 0] - 1] = 3
        code[np.arange(len(fa)) + np.repeat(np.cumsum(gb) - gb, ga)] = after_a * self.width + fa
        code[np.arange(len(fb)) + np.repeat(np.cumsum(ga), gb)] = after_b * self.width + fb
        ends = np.r_[0, np.cumsum(na + nb)].tolist()
        numbers, shown = code.tolist(), self.shown.__getitem__
        shas = [hashlib.sha256("".join(map(shown, numbers[lo:hi])).encode()).hexdigest() if lo < hi else "" for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        size = len(self.b_bytes)
        off, key, times = _counted(doc[~plain], la[~plain] * size + lb[~plain], n, len(self.a_bytes) * size)
        pairs = pa.ListArray.from_arrays(off, pa.array(key // size * SIDE + key % size))
        off_s, key_s, times_s = _counted(doc[plain], la[plain], n, len(self.a_bytes))
        same = pa.ListArray.from_arrays(off_s, pa.array(key_s))
        return [pa.array(na), pa.array(nb), pa.array(groups), pa.array(shas, pa.string()), same, pa.ListArray.from_arrays(off_s, pa.array(times_s)), pairs, pa.ListArray.from_arrays(off, pa.array(times))]


def _counted(doc: np.ndarray, key: np.ndarray, n: int, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of each of n texts the distinct keys (under `most`) and how often each occurs; and where each text's begin."""
    both, times = np.unique(doc * most + key, return_counts=True)
    return pa.array(np.searchsorted(both, np.arange(n + 1) * most).astype(np.int32)), both % most, times.astype(np.int64)


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "pair", "pair_n"]


def align_texts(docs: DataFrame, a_path: str, b_path: str, quick: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: sizes, the digest of its groups, and its linked ids with their numbers."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(a_path, b_path, quick)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), *both.align(strings(b.column(1)))], FIELDS)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = "same array<bigint>, same_n array<bigint>, pair array<bigint>, pair_n array<bigint>"
    return src.mapInArrow(go, f"doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, {counts}")


def _vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's identity links, counted in a vector as long as the largest id."""
    total = np.zeros(0, np.int64)
    for b in batches:
        ids, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        if len(ids):
            total = np.pad(total, (0, max(0, int(ids.max()) + 1 - len(total))))
            np.add.at(total, ids, n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])


def _head_least(pairs: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` pairs have that count or more."""
    sizes = {r[0]: r[1] for r in pairs.groupBy((F.length(F.bin("n")) - 1).alias("p")).count().collect()}
    left, power = most, 63
    while power > 0 and sizes.get(power - 1, 0) <= left:
        power -= 1
        left -= sizes.get(power, 0)
    return 2**power


def _score(same: np.ndarray, count: np.ndarray, best: np.ndarray, head: np.ndarray, head_n: np.ndarray):
    """Adds up what is known of each text's links; links outside the head stay as rest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            flat = {f: b.column(f).flatten().to_numpy(zero_copy_only=False) for f in ("same", "same_n", "pair", "pair_n")}
            doc_s, doc_p = (np.repeat(np.arange(n), np.diff(np.asarray(b.column(f).offsets))) for f in ("same", "pair"))
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            c = count[flat["same"]]
            np.add.at(total, doc_s, flat["same_n"] * c)
            np.add.at(top, doc_s, flat["same_n"] * (c == best[same[flat["same"]]]))
            at = np.minimum(np.searchsorted(head, flat["pair"]), max(len(head) - 1, 0))
            known = head[at] == flat["pair"] if len(head) else np.zeros(len(flat["pair"]), bool)
            c = np.where(known, head_n[at], 0) if len(head) else np.zeros(len(flat["pair"]), np.int64)
            np.add.at(total, doc_p, flat["pair_n"] * c)
            np.add.at(top, doc_p, flat["pair_n"] * (known & (c == best[flat["pair"] % SIDE])))
            off = pa.array(np.searchsorted(doc_p[~known], np.arange(n + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(off, pa.array(flat[f][~known])) for f in ("pair", "pair_n")]
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in ("row", *FIELDS[:5])), pa.array(top), pa.array(total), *rest], ["row", *FIELDS[:5], "n_best", "count_sum", "pair", "pair_n"])

    return go


def default_vocabularies() -> tuple[str, str]:
    folder = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
    return f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, head_pairs: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs.

    Links are the pairs of tokens, one of each side, whose bytes end together; a pair of ids counts the links of the whole
    table that hold it. n_best: links whose count is the highest of their B id; count_sum: the sum of the links' counts.
    Texts that are null, empty, or not given back byte for byte by a tokenizer have no tokens: zeros and an empty digest.
    Repeated ids and null ids are rows of their own; other columns are ignored; an empty table gives an empty result.

    Vectors of vocabulary length and the most frequent pairs, head_pairs at most, go to every task; the other pairs meet
    their counts in a shuffled join, whatever their number. The files must lie at the same place on every machine.
    """
    paths = (a_path, b_path) if a_path and b_path else default_vocabularies()
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/aligned-{uuid.uuid4().hex}"
    align_texts(docs, *paths, same_by_ranks(paths[0]), id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    texts = spark.read.parquet(folder)
    both = Aligner(*paths)
    same = both.same
    count, best = np.zeros(len(both.a_bytes), np.int64), np.zeros(len(both.b_bytes), np.int64)
    for a, n in texts.select("same", "same_n").mapInArrow(_vector, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        count[a] = n
    links = texts.select(F.explode(F.arrays_zip("pair", "pair_n")).alias("l")).groupBy("l.pair").agg(F.sum("l.pair_n").alias("n"))
    pairs = cut(links)
    of_b = pairs.groupBy((F.col("pair") % SIDE).alias("b")).agg(F.max("n")).collect()  # a row for each entry of B at most
    known = same >= 0
    np.maximum.at(best, same[known], count[known])
    for b, n in of_b:
        best[b] = max(best[b], n)
    least = _head_least(pairs, head_pairs)
    top = pairs.where(F.col("n") >= least).toArrow()
    head, head_n = (top.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(head)
    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long, pair array<bigint>, pair_n array<bigint>"
    scored = texts.mapInArrow(_score(same, count, best, head[order], head_n[order]), kinds)
    if least > 1:
        rest = scored.select("row", F.explode(F.arrays_zip("pair", "pair_n")).alias("l")).select("row", "l.pair", "l.pair_n")
        plain = spark.createDataFrame([(int(b), int(n)) for b, n in enumerate(best)], "b long, top long")
        rare = pairs.where(F.col("n") < least).withColumn("b", F.col("pair") % SIDE).join(F.broadcast(plain), "b").select("pair", "n", "top")
        more = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("pair_n") * F.col("n")).alias("more"), F.sum(F.when(F.col("n") == F.col("top"), F.col("pair_n")).otherwise(0)).alias("more_best"))
        scored = scored.drop("pair", "pair_n").join(more, "row", "left").withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0))).withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    out = cut(scored.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"))
    remove(folder)
    return out
