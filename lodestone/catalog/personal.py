"""SQL for the personal-data queries: spans by kinds in order of priority, and what replaces them."""

from __future__ import annotations

from ..functions import pii

#: Blanks as patterns over code points know them; plain `\s` is that of ASCII in SQL.
_BLANKS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The text with a letter of ASCII for each other letter or number: borders of words are then those over code points.
_PLAIN = r"regexp_replace(text, '[^\x{00}-\x{7f}\P{L}]|[^\x{00}-\x{7f}\P{N}]', 'x', 'g')"
_SEPARATED = f"regexp_split_to_array(value, '[-{_BLANKS}]')"


def spans(source: str = "SELECT doc_id, text FROM documents", kinds: dict[str, str] | None = None) -> str:
    """CTEs up to `spans` (doc_id, type, value, start, end, risk): a kind's matches one after another, less those that a span
    of an earlier kind overlaps. source: doc_id, text and what the conditions in kinds, by kind, ask for (kinds not named: none)."""
    out, before = [f"docs AS MATERIALIZED ({source})"], "SELECT NULL::BIGINT AS doc_id, NULL AS type, NULL AS value, 0 AS start, 0 AS \"end\", NULL AS risk WHERE false"
    for kind, pattern, risk in pii.PATTERNS:
        if kinds is not None and kind not in kinds:
            continue
        p = pattern.replace(r"\s", _BLANKS)
        text = _PLAIN if r"\b" in p else "text"
        where = f"regexp_matches({text}, '{p}')" + (f" AND {kinds[kind]}" if kinds else "")
        out.append(f"""{kind}_lists AS (SELECT doc_id, regexp_extract_all({text}, '{p}') AS v, regexp_split_to_array({text}, '{p}') AS s FROM docs WHERE {where}),
 {kind}_at AS (SELECT doc_id, v, s, unnest(range(1, len(v) + 1)) AS i FROM {kind}_lists),
 {kind}_all AS (SELECT doc_id, v[i] AS value, CAST(list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM {kind}_at),
 {kind}_spans AS MATERIALIZED ({before} UNION ALL SELECT doc_id, '{kind}', value, start, start + length(value), '{risk}' FROM {kind}_all c
 WHERE NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.doc_id = c.doc_id AND c.start < t."end" AND t.start < c.start + length(c.value)))""")
        before = f"SELECT * FROM {kind}_spans"
    return ",\n ".join([*out, f"spans AS ({before})"])


_STARS = "repeat('*', length(value))"
#: A value's mask.
MASK = f"""CASE WHEN type = 'resident_id' THEN CASE WHEN contains(value, '-') THEN '******-*******' ELSE '*************' END
 WHEN type = 'business_id' THEN '***-**-*****' WHEN type = 'driver_license' THEN '**-**-******-**' WHEN type = 'ip_address' THEN '***.***.***.***'
 WHEN type = 'phone' AND len({_SEPARATED}) = 3 THEN {_SEPARATED}[1] || '-****-****'
 WHEN type = 'phone' AND length(value) >= 11 THEN left(value, 3) || repeat('*', length(value) - 3)
 WHEN type = 'credit_card' AND len({_SEPARATED}) = 4 THEN '****-****-****-' || {_SEPARATED}[4]
 WHEN type = 'credit_card' THEN repeat('*', length(value) - 4) || right(value, 4)
 WHEN type = 'account' AND length(value) >= 10 THEN left(value, 3) || repeat('*', length(value) - 5) || right(value, 2)
 WHEN type = 'email' THEN left(value, 1) || repeat('*', strpos(value, '@') - 2) || '@' || repeat('*', length(value) - strpos(value, '@') - strpos(reverse(value), '.')) || '.' || right(value, strpos(reverse(value), '.') - 1)
 WHEN type = 'passport' THEN left(value, 1) || repeat('*', length(value) - 1)
 WHEN type = 'mac_address' AND len(string_split(value, ':')) = 6 THEN '**:**:**:**:**:**' WHEN type = 'mac_address' AND len(string_split(value, '-')) = 6 THEN '**-**-**-**-**-**'
 ELSE {_STARS} END"""


def _cases(values: dict[str, str], of: str) -> str:
    return " ".join(f"WHEN {of} = '{k}' THEN '{v}'" for k, v in values.items())


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_AGE = f"(2025 - CASE WHEN substring({_DIGITS}, 7, 1) IN ('3', '4', '7', '8') THEN 2000 ELSE 1900 END - CAST(left({_DIGITS}, 2) AS INT))"
#: A value's broad class.
CLASS = f"""CASE WHEN type = 'resident_id' THEN CASE WHEN {_AGE} >= 70 THEN '70대 이상' WHEN {_AGE} < 20 THEN '10대' ELSE CAST(floor({_AGE} / 10) * 10 AS INT) || '대' END
 WHEN type = 'phone' THEN CASE WHEN substring(value, 3, 1) IN ('0', '1', '6', '7', '8', '9') THEN left(value, 3) || '-****-****' ELSE '휴대전화' END
 WHEN type = 'email' THEN '****@' || substring(value, strpos(value, '@') + 1)
 WHEN type = 'ip_address' THEN regexp_extract(value, '^(.*)[.]', 1) || '.***'
 WHEN type = 'credit_card' THEN CASE {_cases(pii.CARDS, "left(value, 1)")} ELSE '신용카드' END
 WHEN type = 'postal_code' THEN CASE {_cases(dict(zip("01234567", pii.REGIONS, strict=True)), "left(value, 1)")} ELSE '우편번호' END
 {_cases(pii.GENERAL, "type")} ELSE '개인정보' END"""

#: CTE numbered: spans with number, the place of their value among the document's values of the kind.
NUMBERED = """firsts AS (SELECT *, min(start) OVER (PARTITION BY doc_id, type, value) AS f FROM spans),
 numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, type ORDER BY f) AS INT) AS number FROM firsts)"""
#: A value's pseudonym; asks for numbered.
PSEUDONYM = f"CASE {_cases(pii.PSEUDONYMS, 'type')} END || '_' || lpad(CAST(number AS VARCHAR), CAST(greatest(3, length(CAST(number AS VARCHAR))) AS INT), '0')"


def clean(replaced: str) -> str:
    """CTE cleaned (doc_id, clean_text, n): the texts with the rows of the CTE replaced (doc_id, start, end, replacement) put in."""
    return f"""pieces AS (SELECT doc_id, start, "end", replacement, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS b FROM {replaced}),
 parts AS (SELECT doc_id, string_agg(substring(text, CAST(b + 1 AS BIGINT), CAST(start - b AS BIGINT)) || replacement, '' ORDER BY start) AS head, max("end") AS e, count(*) AS n FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
 cleaned AS (SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substring(text, CAST(e + 1 AS BIGINT)) END AS clean_text, CAST(coalesce(n, 0) AS INT) AS n FROM docs LEFT JOIN parts USING (doc_id))"""


LOG = f'WITH {spans()} SELECT doc_id, type, value, start, "end", risk, {MASK} AS replacement FROM spans'
MASKED = f"WITH {spans()}, replaced AS (SELECT *, {MASK} AS replacement FROM spans), {clean('replaced')} SELECT doc_id, clean_text, n FROM cleaned"
PSEUDONYMS = f"WITH {spans()}, {NUMBERED}, replaced AS (SELECT *, {PSEUDONYM} AS replacement FROM numbered), {clean('replaced')} SELECT doc_id, clean_text FROM cleaned"
NUMBERS = f"WITH {spans()}, {NUMBERED} SELECT doc_id, type, start, number FROM numbered"
COUNTS = f"WITH {spans()} SELECT type, count(*) AS n FROM spans GROUP BY type"
RISKS = f"WITH {spans()} SELECT type, {', '.join(f'''count(*) FILTER (risk = '{r}') AS {r}''' for r in ('high', 'medium', 'low'))} FROM spans GROUP BY type"


def by_strategy(of_lang: dict[str, tuple[str, tuple[str, ...]]], other: tuple[str, tuple[str, ...]]) -> str:
    """(doc_id, clean_text) where a language has its strategy and kinds, `other` those of all others."""
    names = ", ".join(f"'{k}'" for k in of_lang)
    allowed = {}
    for kind in pii.KINDS:
        own = ", ".join(f"'{k}'" for k, (how, kinds) in of_lang.items() if kind in kinds and how != "none")
        tests = ([f"lang IN ({own})"] if own else []) + ([f"coalesce(lang NOT IN ({names}), true)"] if kind in other[1] and other[0] != "none" else [])
        if tests:
            allowed[kind] = f"({' OR '.join(tests)})"
    how = f"CASE {_cases({k: s for k, (s, _) in of_lang.items()}, 'lang')} ELSE '{other[0]}' END"
    risk = f"CASE WHEN how <> 'risk' THEN how {_cases(pii.RISK_STRATEGY, 'risk')} END"
    return f"""WITH {spans("SELECT doc_id, text, lang FROM documents", allowed)}, {NUMBERED},
 chosen AS (SELECT n.*, {how} AS how FROM numbered n JOIN docs USING (doc_id)), own AS (SELECT *, {risk} AS own FROM chosen),
 replaced AS (SELECT *, CASE own WHEN 'mask' THEN {MASK} WHEN 'generalize' THEN {CLASS} ELSE {PSEUDONYM} END AS replacement FROM own), {clean('replaced')}
 SELECT doc_id, clean_text FROM cleaned"""
