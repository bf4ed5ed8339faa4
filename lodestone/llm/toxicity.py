"""Toxicity by a weighted finite-state grammar over clauses.

Insults are word patterns (whole words or word beginnings) learned from labelled texts by a likelihood-ratio test that
allows for the number of patterns tried. Negation, reported speech, target and threat are transducers over classes of
words; their composition reads each clause with a match and says in which contexts its matches stand. The weights of the
contexts are those of a logistic curve, fitted on the same labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, slices, strings
from .ngram_join import shingles
from .tokens import mix, words

# Function words of the transducers, whole words in four languages.
TARGET = frozenset("you your yours yourself du dich dir dein deine ihr euch tu toi ton ta vous votre usted tú ti te".split())
NEGATION = frozenset("not never isn't aren't don't nicht kein keine nie jamais aucun nunca jamás".split())
REPORTED = frozenset("said says wrote claimed called quoted sagte schrieb behauptete disait écrit affirmé dijo escribió afirmó".split())
THREAT = frozenset("kill murder destroy hurt töten umbringen tuer assassiner matar asesinar".split())

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"\w+(?:'\w+)*")
OTHER, INSULT, MENACE, AIM, NOT, SAID = range(6)  # classes of words
CLASSES = 6


@dataclass(frozen=True)
class Transducer:
    """move[state][class of word]: the next state; the first state is the one before a clause."""

    move: np.ndarray


def scope(opened_by: int, words: int) -> Transducer:
    """Its state counts down the words that a word of the class still governs."""
    move = np.maximum(np.arange(words + 1) - 1, 0)[:, None].repeat(CLASSES, 1)
    move[:, opened_by] = words
    return Transducer(move)


def seen(of: int) -> Transducer:
    """Its state says whether a word of the class has been read."""
    move = np.array([0, 1])[:, None].repeat(CLASSES, 1)
    move[0, of] = 1
    return Transducer(move)


def compose(*parts: Transducer) -> tuple[Transducer, np.ndarray]:
    """The transducer that runs all parts at once, and the parts' states in each of its states."""
    states = np.array(list(product(*(range(len(p.move)) for p in parts))))
    place = {tuple(x): k for k, x in enumerate(states.tolist())}
    move = [[place[tuple(int(p.move[x, c]) for p, x in zip(parts, own, strict=True))] for c in range(CLASSES)] for own in states.tolist()]
    return Transducer(np.array(move)), states


_WHOLE, _STATES = compose(scope(NOT, 3), scope(SAID, 7), seen(AIM), seen(MENACE))
_MOVE = _WHOLE.move.tolist()
#: What a match adds to: plain, negated, reported matches; all those of a clause with a target; threats with a target.
CONTEXTS = 5
_CONTEXT = [1 if n > 0 else 2 if r > 0 else 0 for n, r, _, _ in _STATES.tolist()]
_FINAL = [(aim == 1, aim == 1 and menace == 1) for _, _, aim, menace in _STATES.tolist()]
_CLASS = {**dict.fromkeys(THREAT, MENACE), **dict.fromkeys(TARGET, AIM), **dict.fromkeys(REPORTED, SAID), **dict.fromkeys(NEGATION, NOT)}
DEFAULT_CURVE = (-3.0, 1.0, 0.0, 0.0, 0.3, 1.0, 0.0, 0.0)


@dataclass(frozen=True)
class Grammar:
    """patterns: word beginnings to weights (a final blank asks for the whole word); curve: weights of _features."""

    patterns: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = DEFAULT_CURVE


class _Reader:
    """Runs the composed transducer over the clauses with a match."""

    def __init__(self, patterns: dict[str, float]):
        self.find = ahocorasick.Automaton()
        for p, w in patterns.items():
            self.find.add_word(p.rstrip(), (p, w))
        for p in THREAT:
            self.find.add_word(p, (p + " ", 0.0)) if p not in self.find else None
        self.find.make_automaton()

    def hits(self, low: str) -> dict[int, float]:
        """Weights by the place where their word begins; 0 for a threat that is no insult."""
        out: dict[int, float] = {}
        n = len(low)
        for end, (p, w) in self.find.iter(low):
            size = len(p.rstrip())
            at = end - size + 1
            if at and (low[at - 1].isalnum() or low[at - 1] == "_"):
                continue
            if p.endswith(" ") and end + 1 < n and (low[end + 1].isalnum() or low[end + 1] == "_"):
                continue
            out[at] = max(out.get(at, 0.0), w)
        return out

    def evidence(self, text: str) -> tuple[list[float], int]:
        """Sums of the matches by context, and the number of clauses with a match of some weight."""
        low = text.lower()
        hits = self.hits(low)
        total, clauses, done = [0.0] * CONTEXTS, 0, -1
        for at in sorted(hits):
            if at < done:
                continue
            lo = max(low.rfind(c, 0, at) for c in ".!?;:\n") + 1
            done = m.end() if (m := _CLAUSE.match(low, lo)) else at + 1
            got = self.clause(low, lo, done, hits)
            clauses += any(got)
            total = [a + b for a, b in zip(total, got, strict=True)]
        return total, clauses

    @staticmethod
    def clause(low: str, lo: int, hi: int, hits: dict[int, float]) -> list[float]:
        """What one clause adds to each context."""
        out, state, threats = [0.0] * CONTEXTS, 0, 0
        for m in _WORD.finditer(low, lo, hi):
            kind, weight = _CLASS.get(m.group(), OTHER), hits.get(m.start(), 0.0)
            if weight:
                out[_CONTEXT[state]] += weight
                kind = INSULT if kind == OTHER else kind
            threats += kind == MENACE and _CONTEXT[state] == 0
            state = _MOVE[state][kind]
        targeted, threatened = _FINAL[state]
        out[3] = sum(out[:3]) if targeted else 0.0
        out[4] = float(threats) if threatened else 0.0
        return out


def _patterns_of(text: str) -> set[str]:
    """Whole words, and their beginnings of 3 to 8 characters, then of lengths that grow by half, to the word's end."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= 3 and not w.isdigit():
            out.add(w + " ")
            k = 3
            while k <= len(w):
                out.add(w[:k])
                k = k + 1 if k < 8 else k * 3 // 2
    return out


def _with_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            sh, first = shingles(words(b.column(0)), 5)
            least = np.zeros(b.num_rows, np.uint64)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                least[some] = np.minimum.reduceat(mix(sh), first[some])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least.view(np.int64))], ["text", "label", "least"])


def _count_patterns(known: dict[str, float]):
    """Texts of each label that have a pattern, by pattern, and all of them under the empty one; toxic texts that a known pattern explains are left out."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(known)
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs = [0, 0]

        def flush():
            keys = list(counts[0].keys() | counts[1].keys())
            arrays = [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())]
            counts[0].clear()
            counts[1].clear()
            return pa.RecordBatch.from_arrays(arrays, ["pattern", "pos", "neg"])

        for b in batches:
            for text, label in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True):
                label = int(bool(label))
                if label and known and any(reader.hits(text.lower()).values()):
                    continue
                docs[label] += 1
                counts[label].update(_patterns_of(text))
                if len(counts[0]) + len(counts[1]) > 150_000:
                    yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([docs[1]]), pa.array([docs[0]])], ["pattern", "pos", "neg"])

    return go


def _llr(pos: int, neg: int, base: float) -> float:
    p = pos / (pos + neg)
    return (pos * math.log(p / base) if pos else 0.0) + (neg * math.log((1 - p) / (1 - base)) if neg else 0.0)


def choose_patterns(rows: list[tuple[str, int, int]], n_pos: int, n_neg: int, tried: int, margin: float = 2.0) -> dict[str, float]:
    """The patterns with a significant surplus in toxic texts; of those that extend each other the one with the greatest
    likelihood ratio, of equal ones the most specific."""
    if not n_pos or not n_neg:
        return {}
    base = n_pos / (n_pos + n_neg)
    need = math.log(max(tried, 2)) + margin
    rated = [(_llr(pos, neg, base), p, pos, neg) for p, pos, neg in rows if pos / (pos + neg) >= max(0.3, 2 * base)]
    kept: dict[str, tuple[int, int]] = {}
    for llr, p, pos, neg in sorted(rated, key=lambda r: (-round(r[0], 6), -len(r[1]), r[1])):
        if llr < need:
            break
        stem = p.rstrip()
        if not any(stem.startswith(k.rstrip()) or k.startswith(stem) for k in kept):
            kept[p] = pos, neg
    return {p: math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1)) for p, (pos, neg) in kept.items()}


def _features(evidence: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Per document: one, the evidence of each context, the length, all evidence for the length (chance matches grow with it)."""
    e, kilo = np.asarray(evidence, float).reshape(-1, CONTEXTS), np.asarray(chars, float) / 1000
    return np.c_[np.ones(len(e)), np.log1p(e), np.log1p(kilo), np.log1p(e[:, :3].sum(axis=1) / (1 + kilo))]


def _fit(evidence: np.ndarray, chars: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve, by Newton's steps with a small ridge."""
    if not len(label) or label.min() == label.max():
        return DEFAULT_CURVE
    x = _features(evidence, chars)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b)), x.T @ (label - p) - 0.05 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def _curve(curve: tuple[float, ...], evidence: list[list[float]], texts: list[str]) -> np.ndarray:
    """Scores; a text without any evidence has that of an empty one at most."""
    e = np.array(evidence, float).reshape(-1, CONTEXTS)
    z = _features(e, np.array([len(t) for t in texts], float)) @ np.array(curve)
    return 1 / (1 + np.exp(-np.clip(np.where(e.any(axis=1), z, np.minimum(z, curve[0])), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_rounds: int = 4) -> Grammar:
    """A grammar from the labelled texts; at most `most_rows` of them, by the hash of their id.

    Patterns are chosen round by round: each round looks at the toxic texts that the patterns found so far do not explain,
    beside all clean ones, until a round finds none. Rows with a null id or label are left out; of several labels of one
    id the greatest holds; null texts are empty. Texts that repeat, even nearly, count once for a label. Without both
    labels present the grammar has no learned pattern. Ties go by the pattern's length, then the pattern. Other columns
    are ignored, whatever their names.
    """
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id").select(F.col("_text").alias("text"), F.col("_label").alias("label"))
    # copies and near-copies of one text are one witness: those whose least shingle hash is the same count once for a label
    sample = sample.mapInArrow(_with_shingle, "text string, label int, least long").groupBy("least", "label").agg(F.min("text").alias("text")).select("text", "label")
    sample = cut(sample)  # at most most_rows texts
    patterns: dict[str, float] = {}
    for _ in range(most_rounds):
        counted = sample.mapInArrow(_count_patterns(patterns), "pattern string, pos long, neg long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counted = cut(counted.where("pos + neg >= 4 or pattern = ''"))
        total = counted.where("pattern = ''").collect()
        n_pos, n_neg = (total[0].pos, total[0].neg) if total else (0, 0)
        rows = counted.where("pattern != '' and pos >= 3 and pos >= 0.3 * (pos + neg)").collect()  # patterns of at most most_rows texts
        new = choose_patterns([(r.pattern, r.pos, r.neg) for r in rows], n_pos, n_neg, counted.count())
        new = {p: w for p, w in new.items() if p not in patterns}
        if not new:
            break
        patterns |= new
    got = sample.mapInArrow(_evidence(patterns), "label int, evidence array<double>, chars long").toPandas()  # at most most_rows
    return Grammar(patterns, _fit(np.array([list(e) for e in got["evidence"]]), got["chars"].to_numpy(), got["label"].to_numpy()))


def _evidence(patterns: dict[str, float]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(patterns)
        for b in batches:
            texts = strings(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([reader.evidence(t)[0] for t in texts], pa.list_(pa.float64())), pa.array([len(t) for t in texts], pa.int64())], ["label", "evidence", "chars"])

    return go


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted, clauses): one row per row of docs; null and empty texts have no clause and the base score."""
    return mark(docs.select(id_col, text_col), grammar, text_col, threshold).drop(text_col)


def mark(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score, predicted and clauses (see score) in place of columns of these names; in one pass, without a join.

    Every row is judged by its own text, whatever its id; repeated rows alike. Scores at the threshold count as toxic.
    """
    docs = docs.drop("score", "predicted", "clauses")
    names = docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(grammar.patterns)
        for b in batches:
            texts = strings(b.column(text_col))
            got = [reader.evidence(t) for t in texts]
            s = _curve(grammar.curve, [e for e, _ in got], texts) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([g[1] for g in got], pa.int32())], [*names, "score", "predicted", "clauses"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(go, f"{schema}, score double, predicted int, clauses int")


def train_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where(crc_mod(id_col, 3) != 1)
