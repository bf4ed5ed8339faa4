"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The field is trained on a small labelled table of word sequences and reads every word of a text. What it makes of a word
depends on the word and its neighbours alone, so that a word's weights are looked up once a task. Stretches in which no
span could raise the score of a text are outside in the best path; Viterbi decoding runs in numpy over batches of the
others, which gives the path of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, strings

KINDS = ("email", "ip", "card", "phone")  # of the fixed patterns, in the order in which spans are listed
ALL_KINDS = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in ALL_KINDS for p in "BI"))
CONTEXT = 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: a match begins where the run of local characters before it begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as in KINDS, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 16:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- sequences and features ---------------------------------------------------------------------------------------

_TRIM = "\"'`.,;:!?()[]{}<>$&%#*|"


_SHAPES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-zß-ɏ]+"), "a"))


def _shape(word: str) -> str:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 5)}", word)


SIDES = ("<<", "<", ">", ">>")  # names of the features of the words two and one before, one and two after


def _core(word: str) -> str:
    return word.strip(_TRIM) or word


def own_features(word: str) -> list[str]:
    """Names of the features of a word by itself."""
    w = _core(word)
    digits = sum(c.isdigit() for c in w)
    letters = sum(c.isalpha() for c in w)
    own = ["1", f"s={_shape(w)}", f"d={min(digits, 17)}", f"n={min(len(w) // 4, 10)}", f"r={digits * 4 // max(1, len(w))}"]
    own.append("mix" if digits > 2 and letters > 2 and len(w) >= 12 else "-mix")
    own += ["luhn"] if 16 <= digits <= 19 and letters == 0 and luhn("".join(c for c in w if "0" <= c <= "9")) else []
    own += [f"has{c}" for c in "@=_" if c in w]
    own += [f"hex={len(w) >= 16}"] if re.fullmatch(r"[0-9a-f]+", w) and digits and letters else []
    own += [f"p={w[:4]}"] if w[:4].isupper() else []
    own += [f"w={w.lower()}"] if w.isalpha() and len(w) <= 9 and w.isascii() else []
    own += [f"before={w.partition('=')[0].lower()}"] if "=" in w[1:-1] else []
    own += [f"a={word}"] if not any(c.isalnum() for c in word) else []
    return own


def side_feature(word: str | None) -> str:
    """What a word is to its neighbours: itself where it is short and without digits, else its shape; a bar beyond the text's ends."""
    if word is None:
        return "|"
    c = _core(word)
    return c.lower() if len(c) <= 9 and not any(x.isdigit() for x in c) else _shape(c)


def features(words: list[str]) -> list[list[str]]:
    """Names of the features that hold at each word of a sequence."""
    near = lambda k: words[k] if 0 <= k < len(words) else None
    return [own_features(w) + [name + side_feature(near(i + k)) for name, k in zip(SIDES, (-2, -1, 1, 2), strict=True)] for i, w in enumerate(words)]


# ---- the labelled table -------------------------------------------------------------------------------------------


def labelled_table(spark: SparkSession, rows: int = 780, seed: int = 3) -> DataFrame:
    """The small labelled table (words array<string>, tags array<string>), drawn from rules with a fixed seed."""
    return spark.createDataFrame(labelled_rows(rows, seed), "words array<string>, tags array<string>")


def labelled_rows(rows: int, seed: int) -> list[tuple[list[str], list[str]]]:
    rng = np.random.default_rng(seed)
    pick = lambda s, n: "".join(s[k] for k in rng.integers(0, len(s), n))
    letters, digits, hexes, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    word = lambda: pick(letters, int(rng.integers(2, 9)))

    def card() -> str:
        stem = "4" + pick(digits, 14)
        return next(stem + c for c in digits if luhn(stem + c))

    def one(kind: int) -> tuple[list[str], list[str]]:
        name, host = word(), word() + pick(digits, 1)
        made: list[tuple[list[str], str]] = [
            ([f"{name}.{pick(digits, 2)}@{host}.example.com"], "email"), ([name, "at", host, "dot", "com"], "email"), ([f"{name}@{host}"], "O"),
            ([".".join(str(x) for x in rng.integers(1, 255, 4))], "ip"), (["version", ".".join(str(x) for x in rng.integers(0, 20, 3))], "O"), (["license", f"{rng.integers(1, 9)}.0."], "O"),
            ([card()], "card"), ([card()] if rng.random() < 0.5 else [card()[k : k + 4] for k in (0, 4, 8, 12)], "card"), ([pick(digits, int(rng.integers(1, 13)))], "O"),
            (["+1", f"({pick(digits, 3)})", f"{pick(digits, 3)}-{pick(digits, 4)}"], "phone"), ([f"({pick(digits, 3)})", f"{pick(digits, 3)}-{pick(digits, 4)}"], "phone"), ([f"{rng.integers(1990, 2030)}-{pick('01', 2)}-{pick('012', 2)}"], "O"),
            (["AKIA" + pick(upper, 16)], "secret"), ([f"password={pick(hexes, int(rng.integers(12, 24)))}"], "secret"), (["token", "=", f'"{pick(hexes, 40)}"'], "token"),
            ([name, "at", word(), "dot", ["com", "org", "net"][int(rng.integers(3))]], "email"), ([f"{['password', 'token', 'secret', 'api_key'][int(rng.integers(4))]}={pick(letters, int(rng.integers(8, 24)))}"], "secret"),
            ([["at", "de", "dot", "com", name][int(rng.integers(5))]] * int(rng.integers(3, 9)), "O"), ([word(), "de", word(), "de"], "O"), (["dot", word(), "at", word()], "O"),
            ([["the", "a", "each"][int(rng.integers(3))], ["token", "password", "key", "secret", "dot"][int(rng.integers(5))]], "O"), ([name, "at", word()], "O"), ([f"{name}={pick(letters, 4)}"], "O"), ([name.capitalize() + ".", word().capitalize()], "O"), ([word() + pick(letters, 8) + "," , word() + "."], "O"),
            ([f"{word()}{pick(digits, 2)}"], "O"), ([f"https://{name}.example.com/{pick(digits, 4)}"], "O"), ([f"{pick(digits, 2)}:{pick(digits, 2)}"], "O"), ([f"{pick(digits, 1)},{pick(digits, 3)}.{pick(digits, 2)}"], "O"),
        ]
        words, tag = made[kind % len(made)]
        if tag == "O":
            tags = ["O"] * len(words)
        elif tag == "token":
            tags = ["O", "O", "B-secret"]
        else:
            tags = [f"B-{tag}", *[f"I-{tag}"] * (len(words) - 1)]
        if kind % len(made) == 0 and rng.random() < 0.3:
            words = [words[0] + ","]
        left, right = [word() for _ in range(CONTEXT)], [word() for _ in range(CONTEXT)]
        return [*left, *words, *right], ["O"] * CONTEXT + tags + ["O"] * CONTEXT

    return [one(k) for k in range(rows)]


# ---- the field ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """index: feature to row of weights; move: weights of tag pairs; begin, end: of the first and the last tag."""

    index: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def rows(self, names: list[str]) -> np.ndarray:
        """The weights of the named features, added up for each tag."""
        return self.weights[[k for f in names if (k := self.index.get(f)) is not None]].sum(axis=0)

    def emissions(self, words: list[str]) -> np.ndarray:
        return np.stack([self.rows(fs) for fs in features(words)])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: Iterable[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4, least: int = 4) -> Field:
    """Maximises the conditional likelihood by AdaGrad with forward-backward, over sequences of equal length at once.

    Features that hold at fewer than `least` words of the table are left out: a rare word says nothing of others.
    """
    named = [(features(list(words)), tags) for words, tags in rows]
    often = Counter(f for feats, _ in named for fs in feats for f in fs)
    index = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= least))}
    by_len: dict[int, list] = {}
    tag_no = {t: k for k, t in enumerate(TAGS)}
    for feats, tags in named:
        by_len.setdefault(len(tags), []).append(([[index[f] for f in fs if f in index] for fs in feats], [tag_no[t] for t in tags]))
    k, n_rows = len(TAGS), sum(map(len, by_len.values()))
    sets = []
    for size, group in by_len.items():
        flat = [(b * size + t, f) for b, (feats, _) in enumerate(group) for t, fs in enumerate(feats) for f in fs]
        sets.append((size, len(group), np.array([x for x, _ in flat]), np.array([f for _, f in flat]), np.array([y for _, y in group])))
    w, move, begin, end = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
    hist = [np.full_like(p, 1e-6) for p in (w, move, begin, end)]
    for _ in range(rounds):
        grads = [-ridge * n_rows * p for p in (w, move, begin, end)]
        for size, n, place, feat, y in sets:
            e = np.zeros((n * size, k))
            np.add.at(e, place, w[feat])
            e = e.reshape(n, size, k)
            fwd, bwd = np.zeros((size, n, k)), np.zeros((size, n, k))
            fwd[0] = begin + e[:, 0]
            for t in range(1, size):
                fwd[t] = _lse(fwd[t - 1][:, :, None] + move[None], 1) + e[:, t]
            bwd[-1] = end
            for t in range(size - 2, -1, -1):
                bwd[t] = _lse(move[None] + (e[:, t + 1] + bwd[t + 1])[:, None, :], 2)
            z = _lse(fwd[-1] + end, 1)
            marg = np.exp(fwd + bwd - z[None, :, None])
            gold = np.eye(k)[y.T]
            diff = (gold - marg).transpose(1, 0, 2).reshape(n * size, k)
            np.add.at(grads[0], feat, diff[place])
            for t in range(1, size):
                pair = np.exp(fwd[t - 1][:, :, None] + move[None] + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None])
                grads[1] += np.einsum("na,nb->ab", gold[t - 1], gold[t]) - pair.sum(axis=0)
            grads[2] += (gold[0] - marg[0]).sum(axis=0)
            grads[3] += (gold[-1] - marg[-1]).sum(axis=0)
        for p, g, h in zip((w, move, begin, end), grads, hist, strict=True):
            h += g * g
            p += rate * g / np.sqrt(h)
    return Field(index, w, move, begin, end)


def _moves(field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Weights of tag pairs and of first tags; tags that cannot follow each other do not."""
    bad = np.array([[t[0] == "I" and (s == "O" or s[2:] != t[2:]) for t in TAGS] for s in TAGS])
    return np.where(bad, -1e9, field.move), np.where([t[0] == "I" for t in TAGS], -1e9, field.begin)


def viterbi(field: Field, emissions: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Best tags of sequences of equal length: (n, size, tags) to (n, size). first, last (n): whether a text begins or ends with
    the sequence; elsewhere the word before, or after, is outside."""
    n, size, k = emissions.shape
    move, begin = _moves(field)
    first = np.ones(n, bool) if first is None else first
    last = np.ones(n, bool) if last is None else last
    score = np.where(first[:, None], begin, move[0]) + emissions[:, 0]
    back = np.zeros((size, n, k), np.int8)
    for t in range(1, size):
        step = score[:, :, None] + move[None]
        back[t] = step.argmax(axis=1)
        score = step.max(axis=1) + emissions[:, t]
    tags = np.zeros((n, size), np.int64)
    tags[:, -1] = (score + np.where(last[:, None], field.end, move[:, 0])).argmax(axis=1)
    for t in range(size - 1, 0, -1):
        tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
    return tags


class Decoder:
    """The field over whole texts. Weights of words seen before are kept, up to most_words of them."""

    def __init__(self, field: Field, most_words: int = 400_000):
        self.field, self.most = field, most_words
        move, begin = _moves(field)
        # the most that a tag's move can bring a path, against one that is outside; leaving a span comes once for all its words
        self.into = np.maximum(move.max(axis=0) - move[0, 0], begin - begin[0])[1:]
        self.leave = max((move[1:, 0] - move[0, 0]).max(), (field.end[1:] - field.end[0]).max())
        self.edges = [field.rows([name + side_feature(None)]) for name in SIDES]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # words to rows of the table
        self.alike: dict[tuple, int] = {}  # what the field knows of a word to its row
        self.made: list[np.ndarray] = []
        self.table = np.zeros((0, 5, len(TAGS)))

    def _row(self, word: str) -> int:
        """The row of a word; words of letters alone share one where the field knows no more of them than their shape and length."""
        index, c = self.field.index, word.strip(_TRIM)
        if c.isalpha():
            shape = "a" if c.isascii() and c.islower() else "Aa" if c.isascii() and c[1:].islower() and c[0].isupper() else _shape(c)
            low = c.lower()
            side = low if len(c) <= 9 else shape
            key = (shape, min(len(c) // 4, 10), low if len(c) <= 9 and f"w={low}" in index else "", c[:4] if c[:4].isupper() else "", side if any(name + side in index for name in SIDES) else "")
        else:
            key = (word,)
        row = self.alike.get(key)
        if row is None:
            row = self.alike[key] = len(self.made)
            side = side_feature(word)
            self.made.append(np.array([self.field.rows(own_features(word)), *(self.field.rows([name + side]) for name in SIDES)]))
        return row

    def _weights(self, parts: list[str]) -> np.ndarray:
        """For each word its row in the table: the weights of its tags, as itself and as the neighbour of each side."""
        if len(self.known) > self.most or len(self.made) > self.most:
            self._forget()
        known = self.known
        for w in set(parts).difference(known):
            known[w] = self._row(w)
        if len(self.made) > len(self.table):
            self.table = np.concatenate([self.table, np.array(self.made[len(self.table) :])])
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the tags of all words of all texts, and where each text's words begin (and the end)."""
        first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        row = self._weights([w for t in texts for w in t])
        n = len(row)
        out = self.table[row, 0] if n else np.zeros((0, len(TAGS)))
        place = np.arange(n)
        lo, hi = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        for side, (edge, k) in enumerate(zip(self.edges, (-2, -1, 1, 2), strict=True), 1):
            near = place + k
            inside = (near >= lo) & (near < hi)
            out += np.where(inside[:, None], self.table[row[np.clip(near, 0, max(n - 1, 0))], side], edge) if n else 0
        return out, first

    def tags(self, texts: list[list[str]], most_cells: int = 400_000) -> list[tuple[int, int, np.ndarray]]:
        """(text, first word, tags) of the stretches that may hold spans; all other words are outside."""
        e, first = self.emissions(texts)
        if not len(e):
            return []
        sums = np.r_[0.0, np.cumsum((e[:, 1:] + self.into).max(axis=1) - e[:, 0])]
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        # words of some interval in its text that, with leaving it, may gain: the greatest rise of the sums around the word
        least = _running(sums[:-1], first, np.minimum)
        most = _running(sums[1:][::-1], len(e) - first[::-1], np.maximum)[::-1]
        open_ = most - least + self.leave >= 0
        begin = np.flatnonzero(open_ & ~(np.r_[False, open_[:-1]] & np.r_[False, text[1:] == text[:-1]]))
        end = np.flatnonzero(open_ & ~(np.r_[open_[1:], False] & np.r_[text[1:] == text[:-1], False])) + 1
        out = []
        size = end - begin
        for length in np.unique(size):
            group = np.flatnonzero(size == length)
            for at in range(0, len(group), step := max(1, most_cells // int(length))):
                g = group[at : at + step]
                best = viterbi(self.field, e[begin[g][:, None] + np.arange(length)], begin[g] == first[text[begin[g]]], end[g] == first[text[begin[g]] + 1])
                out += [(int(text[begin[k]]), int(begin[k] - first[text[begin[k]]]), row) for k, row in zip(g, best, strict=True) if row.any()]
        return out


def _running(values: np.ndarray, first: np.ndarray, how: np.ufunc) -> np.ndarray:
    """The running least or greatest value within each text."""
    out = np.empty_like(values)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        how.accumulate(values[lo:hi], out=out[lo:hi])
    return out


def field_spans(decoder: Decoder, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, without quotes and punctuation at their ends."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    places: dict[int, list[tuple[int, int]]] = {}
    for d, start, row in sorted(decoder.tags([t.split() for t in texts]), key=lambda x: x[:2]):
        if d not in places:
            places[d] = [m.span() for m in re.finditer(r"\S+", texts[d])]
        seq, i = places[d][start : start + len(row)], 0
        while i < len(seq):
            tag = TAGS[row[i]]
            j = i + 1
            if tag[0] == "B":
                while j < len(seq) and TAGS[row[j]] == f"I{tag[1:]}":
                    j += 1
                a, b = seq[i][0], seq[j - 1][1]
                while a < b and texts[d][a] in _TRIM.replace("(", ""):
                    a += 1
                while b > a and texts[d][b - 1] in _TRIM.replace(")", ""):
                    b -= 1
                if b > a:
                    out[d].append((tag[2:], a, b))
            i = j
    return out


def _find(field: Field):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            for b in slices(batch, "text"):
                texts = strings(b.column(1))
                base = [base_spans(t) for t in texts]
                more = field_spans(decoder, texts)
                counts, fixed = {k: [] for k in ALL_KINDS}, {k: [] for k in KINDS}
                digest, spans = [], []
                for own, added in zip(base, more, strict=True):
                    free = [s for s in added if not any(s[1] < e and a < s[2] for _, a, e in own)]
                    full = sorted([*own, *free], key=lambda s: (ALL_KINDS.index(s[0]), s[1]))
                    for k in ALL_KINDS:
                        counts[k].append(sum(s[0] == k for s in full))
                    for k in KINDS:
                        fixed[k].append(sum(s[0] == k for s in own))
                    digest.append(hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in own).encode()).hexdigest())
                    spans.append(full)
                kinds = pa.array([[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(counts[k], pa.int64()) for k in ALL_KINDS), pa.array(digest), kinds, *(pa.array(fixed[k], pa.int64()) for k in KINDS)], ["doc_id", "text", *(f"n_{k}" for k in ALL_KINDS), "base_sha256", "spans", *(f"base_{k}" for k in KINDS)])

    return go


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2_000) -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans array<struct<kind, start, end>>, base_email, base_ip, base_card, base_phone).

    The counts n_ are those of all spans, base_ those of the fixed patterns alone.
    One row per row of docs; repeated rows and null ids are rows of their own. Spans of the fixed patterns always stay;
    those of the field, which reads every word of a text, are added where they touch none. Null and empty texts hold nothing. The field is trained on at most most_rows rows of the labelled table, by the hash
    of their words. Other columns of docs are ignored.
    """
    if labelled is None:
        rows = labelled_rows(780, 3)
    else:
        rows = [(r.words, r.tags) for r in labelled.orderBy(F.xxhash64("words"), "words").limit(most_rows).collect()]
    field = train(rows)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    counts, fixed = ", ".join(f"n_{k} bigint" for k in ALL_KINDS), ", ".join(f"base_{k} bigint" for k in KINDS)
    return src.mapInArrow(_find(field), f"doc_id {kind}, text string, {counts}, base_sha256 string, spans array<struct<kind: string, start: bigint, end: bigint>>, {fixed}")


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap the first to begin counts."""
    out, at = [], 0
    for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_rows(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with personal data masked in the text (null stays null); in one pass, without a join."""
    field = field or train(labelled_rows(780, 3))
    at = docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        for batch in batches:
            for b in slices(batch, text_col):
                texts = strings(b.column(at))
                new = []
                for text, own, added in zip(texts, map(base_spans, texts), field_spans(decoder, texts), strict=True):
                    free = [s for s in added if not any(s[1] < e and a < s[2] for _, a, e in own)]
                    new.append(mask_text(text, [*own, *free]) if own or free else text)
                masked = pa.array([None if x is None else y for x, y in zip(b.column(at).to_pylist(), new, strict=True)], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], masked, *b.columns[at + 1 :]], schema=b.schema)

    return docs.mapInArrow(go, docs.schema)
