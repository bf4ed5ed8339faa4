"""Detection and anonymisation of personal data by typed patterns in a fixed priority."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in priority order, their pattern and risk.
PATTERNS = (
    ("resident_id", r"[0-9]{6}[-\s]?[1-4][0-9]{6}", "high"),
    ("passport", r"[A-Z]{1}[0-9]{8}|[A-Z]{2}[0-9]{7}", "high"),
    ("driver_license", r"[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}", "high"),
    ("foreign_id", r"[0-9]{6}[-\s]?[5-8][0-9]{6}", "high"),
    ("phone", r"01[0-9][-\s]?[0-9]{3,4}[-\s]?[0-9]{4}", "medium"),
    ("telephone", r"0[0-9]{1,2}[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}", "medium"),
    ("credit_card", r"[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}", "high"),
    ("account", r"[0-9]{6,14}", "high"),
    ("business_id", r"[0-9]{3}-[0-9]{2}-[0-9]{5}", "medium"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "low"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "low"),
    ("mac_address", r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})", "low"),
    ("postal_code", r"\b[0-9]{5}\b", "low"),
)
KINDS = tuple(p[0] for p in PATTERNS)
RISK = {k: r for k, _, r in PATTERNS}
#: Names of pseudonyms.
PSEUDONYMS = {
    "resident_id": "RRN", "phone": "PHONE", "email": "EMAIL", "credit_card": "CARD", "account": "ACCOUNT", "business_id": "BIZ", "passport": "PASSPORT",
    "driver_license": "LICENSE", "foreign_id": "FOREIGN", "ip_address": "IP", "mac_address": "MAC", "postal_code": "POSTAL", "telephone": "TEL",
}
#: What a kind becomes when it is generalised as a whole.
GENERAL = {"business_id": "사업자번호", "account": "계좌번호", "passport": "여권번호", "driver_license": "운전면허", "foreign_id": "외국인등록번호", "mac_address": "MAC주소", "telephone": "전화번호"}
REGIONS = ("서울", "경기", "인천", "강원", "충남/충북", "전남/전북", "경남/경북", "제주")
CARDS = {"4": "VISA카드", "5": "MasterCard", "3": "AMEX/Diners", "9": "국내카드"}

_COMPILED = {k: re.compile(p) for k, p, _ in PATTERNS}
_NEEDS = re.compile(r"[0-9]{4}|[0-9]{3}-|@|\.[0-9]|[0-9A-Fa-f]{2}[:-]")


def detect(text: str | None, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start; kinds earlier in the order take a span before later ones may overlap it."""
    if not text or not _NEEDS.search(text):
        return []
    taken: list[tuple[str, int, int]] = []
    for kind in KINDS:
        if kind not in kinds or kind == "email" and "@" not in text:
            continue
        earlier = len(taken)
        for m in _COMPILED[kind].finditer(text):
            if not any(m.start() < e and s < m.end() for _, s, e in taken[:earlier]):
                taken.append((kind, *m.span()))
    return sorted(taken, key=lambda x: x[1])


#: Masks by kind: patterns of a whole value, and what it becomes: a text, the n-th group as it is (n), or a star for each
#: of its characters (-n). The first pattern that fits counts; without one every character becomes a star.
MASKS: dict[str, tuple[tuple[str, tuple], ...]] = {
    "resident_id": ((r".*-.*", ("******-*******",)), (r".*", ("*" * 13,))),
    "business_id": ((r".*-.*", ("***-**-*****",)),),
    "driver_license": ((r".*-.*", ("**-**-******-**",)),),
    "phone": ((r"([^-\s]*)[-\s][^-\s]*[-\s][^-\s]*", (1, "-****-****")), (r"(.{3})(.{8,})", (1, -2))),
    "credit_card": ((r"(?:[^-\s]*[-\s]){3}([^-\s]*)", ("****-****-****-", 1)), (r"(.{12,})(.{4})", (-1, 2))),
    "account": ((r"(.{3})(.{5,})(.{2})", (1, -2, 3)),),
    "email": ((r"([^@]?)([^@]*)@(.*)\.([^.]*)", (1, -2, "@", -3, ".", 4)),),
    "passport": ((r"([^\W\d_])(.*)", (1, -2)),),
    "ip_address": ((r"[^.]*(?:\.[^.]*){3}", ("***.***.***.***",)),),
    "mac_address": ((r"[^:]*(?::[^:]*){5}", ("**:**:**:**:**:**",)), (r"[^-]*(?:-[^-]*){5}", ("**-**-**-**-**-**",))),
}
_MASKS = {k: tuple((re.compile(p, re.DOTALL), parts) for p, parts in rules) for k, rules in MASKS.items()}


def _filled(m: re.Match, parts: tuple) -> str:
    return "".join(x if isinstance(x, str) else m[x] if x > 0 else "*" * len(m[-x]) for x in parts)


def mask(value: str, kind: str) -> str:
    fits = ((m, parts) for pattern, parts in _MASKS.get(kind, ()) if (m := pattern.fullmatch(value)))
    return next((_filled(m, parts) for m, parts in fits), "*" * len(value))


#: Broad classes by kind: patterns as above; a class for the first digit; the class of all else.
_BROAD = {
    "phone": (re.compile(r"(01[016789]).*", re.DOTALL), (1, "-****-****")),
    "email": (re.compile(r"[^@]*@?(.*)", re.DOTALL), ("****@", 1)),
    "ip_address": (re.compile(r"(.*)\.[^.]*", re.DOTALL), (1, ".***")),
}
_BY_DIGIT = {"postal_code": dict(zip("01234567", REGIONS, strict=True)), "credit_card": CARDS}
_ELSE = GENERAL | {"phone": "휴대전화", "postal_code": "우편번호", "credit_card": "신용카드", "ip_address": ".***"}


def _age_class(value: str, year: int) -> str:
    """The decade of the age, from 10 to 70, of the holder of a resident number; its seventh digit tells the century,
    also of a number with a blank in its middle (by intent: there the seventh character would be no digit of the century)."""
    digits = [c for c in value if "0" <= c <= "9"]
    century = 20 if len(digits) > 6 and digits[6] in "3478" else 19
    decade = (year - century * 100 - int("".join(digits[:2]))) // 10 * 10
    return "70대 이상" if decade >= 70 else f"{max(decade, 10)}대"


def generalize(value: str, kind: str, year: int = 2025) -> str:
    """The value's broad class; the year is the one that ages are counted from."""
    if kind == "resident_id":
        return _age_class(value, year)
    if kind in _BROAD and (m := _BROAD[kind][0].fullmatch(value)):
        return _filled(m, _BROAD[kind][1])
    return _BY_DIGIT.get(kind, {}).get(value[:1]) or _ELSE.get(kind, "개인정보")


#: The strategy for each risk, and the kinds that are looked for unless others are named.
RISK_STRATEGY = {"high": "mask", "medium": "generalize", "low": "pseudonymize"}
ENABLED = ("resident_id", "foreign_id", "phone", "telephone", "business_id", "driver_license", "passport", "credit_card", "email")


def anonymize(text: str, spans: list[tuple[str, int, int]], strategy: str = "mask") -> tuple[str, list[str]]:
    """The text with its spans replaced, and the replacements in order. Pseudonyms are numbered as values first appear.

    The strategy 'risk' takes for each span that of its kind's risk.
    """
    numbers: dict[tuple[str, str], int] = {}
    counts: dict[str, int] = {}
    made = []
    for kind, a, e in spans:
        value = text[a:e]
        how = RISK_STRATEGY[RISK[kind]] if strategy == "risk" else strategy
        if how == "mask":
            made.append(mask(value, kind))
        elif how == "generalize":
            made.append(generalize(value, kind))
        elif how == "pseudonymize":
            if (kind, value) not in numbers:
                counts[kind] = numbers[kind, value] = counts.get(kind, 0) + 1
            made.append(f"{PSEUDONYMS[kind]}_{numbers[kind, value]:03d}")
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
    out, at = [], 0
    for (_, a, e), new in zip(spans, made, strict=True):
        out += [text[at:a], new]
        at = e
    return "".join([*out, text[at:]]), made


def anonymized(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS, strategy: str = "mask", strategy_col: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """df with clean_text and matches array<struct<type, value, start, end, risk, replacement>>; all other columns stay.

    With strategy_col the strategy is that column's (null: `strategy`; 'none': nothing is replaced), with kinds_col, an
    array<string>, the kinds are that column's (null: `kinds`).
    """
    names = df.columns
    item = pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("risk", pa.string()), ("replacement", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, found = [], []
            how = b.column(strategy_col).to_pylist() if strategy_col else [strategy] * b.num_rows
            which = b.column(kinds_col).to_pylist() if kinds_col else [None] * b.num_rows
            for text, s, own in zip(b.column(text_col).to_pylist(), how, which, strict=True):
                spans = detect(text, kinds if own is None else tuple(own)) if s != "none" else []
                new, made = anonymize(text, spans, s or strategy) if spans else (text, [])
                clean.append(new)
                found.append([{"type": k, "value": text[a:e], "start": a, "end": e, "risk": RISK[k], "replacement": r} for (k, a, e), r in zip(spans, made, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(clean, pa.string()), pa.array(found, pa.list_(item))], [*names, "clean_text", "matches"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(go, f"{schema}, clean_text string, matches array<struct<type:string,value:string,start:bigint,end:bigint,risk:string,replacement:string>>")


def match_rows(anonymised: DataFrame, *keep: str) -> DataFrame:
    """One log row a match."""
    return anonymised.select(*keep, F.explode("matches").alias("m")).select(*keep, "m.*")


def count_kind(kind: str, text: Column | str = "text") -> Column:
    """Matches of one kind alone, without the others' priority."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(dict((k, p) for k, p, _ in PATTERNS)[kind])).cast("bigint")


def with_strategy(docs: DataFrame, config: DataFrame, default: str = "mask", enabled: tuple[str, ...] = ENABLED) -> DataFrame:
    """docs with strategy and, where config has them, kinds by file_type; config: (file_type, strategy[, kinds array<string>])."""
    from ..operators.joins import small

    out = docs.join(small(config), "file_type", "left").withColumn("strategy", F.coalesce("strategy", F.lit(default)))
    return out.withColumn("kinds", F.coalesce("kinds", F.array(*map(F.lit, enabled)))) if "kinds" in config.columns else out
