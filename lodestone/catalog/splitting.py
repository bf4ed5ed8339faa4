"""SQL for recursive splitting: texts cut by one separator after another, short neighbours joined up to a size with an overlap."""

from __future__ import annotations

from ..functions.chunking import SEPARATORS

_TRIM = r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _literal(sep: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep) or "''"


def pieces(source: str, size: int, overlap: int) -> str:
    """CTEs, to follow WITH RECURSIVE, up to `pieces` (key, path, k, text): the pieces of the texts of source (key, text), which stand in the order of path and k.

    Of each level's texts those that have its separator are cut; parts of `size` characters go on to the next level, runs
    of shorter ones are packed: from the place where a piece begins follow the place where it ends, and the one where the next begins.
    """
    out = [f"todo_0 AS (SELECT key, CAST([] AS BIGINT[]) AS path, text FROM ({source}) WHERE text <> '')"]
    for k, sep in enumerate(SEPARATORS):
        s, last = _literal(sep), k == len(SEPARATORS) - 1
        cut = f"[CASE WHEN i = 1 THEN x ELSE {s} || x END FOR x, i IN string_split(text, {s})]" if sep else "string_split(text, '')"
        has = f"contains(text, {s})" if sep else "true"
        out.append(f"""cut_{k} AS (SELECT key, path, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT key, path, {cut} AS parts FROM todo_{k} WHERE {has})),
 part_{k} AS (SELECT *, {"true" if last else f"length(part) < {size}"} AS short FROM cut_{k} WHERE part <> ''),
 run_{k} AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY key, path ORDER BY i) AS run FROM part_{k}),
 short_{k} AS (SELECT key, list_append(path, min(i) OVER (PARTITION BY key, path, run)) AS path, i, part FROM run_{k} WHERE short)""")
        if not last:
            out.append(f"todo_{k + 1} AS (SELECT key, path, text FROM todo_{k} WHERE NOT {has} UNION ALL SELECT key, list_append(path, i), part FROM run_{k} WHERE NOT short)")
    shorts = " UNION ALL ".join(f"SELECT key, path, i, part FROM short_{k}" for k in range(len(SEPARATORS)))
    out.append(f"""shorts AS MATERIALIZED ({shorts}),
 joined AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT key, path, string_agg(part, '' ORDER BY i) AS text FROM shorts GROUP BY key, path)),
 places AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) AS b, CAST(sum(length(part)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS p FROM shorts JOIN joined USING (key, path)
  UNION ALL SELECT r, 0, 0 FROM joined),
 gaps AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 0) AS gap FROM places),
 ends AS MATERIALIZED (SELECT r, b, p, max(b) OVER (PARTITION BY r ORDER BY p RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) AS to_b,
  min(b) OVER (PARTITION BY r ORDER BY p RANGE BETWEEN least({overlap}, {size} - gap) PRECEDING AND CURRENT ROW) AS next_b, max(b) OVER (PARTITION BY r) AS n FROM gaps),
 step AS MATERIALIZED (SELECT a.r, a.b, a.p, e.p AS to_p, CASE WHEN e.b < e.n THEN e.next_b END AS next_b FROM ends a JOIN ends e ON e.r = a.r AND e.b = a.to_b),
 packed AS (SELECT r, 0 AS k, p, to_p, next_b FROM step WHERE b = 0 UNION ALL SELECT s.r, k + 1, s.p, s.to_p, s.next_b FROM packed q JOIN step s ON s.r = q.r AND s.b = q.next_b),
 pieces AS (SELECT key, path, k, text FROM (SELECT key, path, k, regexp_replace(regexp_replace(substring(text, p + 1, to_p - p), '{_TRIM}', ''), '{_TRIM[1:]}$', '') AS text FROM packed JOIN joined USING (r)) WHERE text <> '')""")
    return ",\n ".join(out)


def packed(source: str, most: int) -> str:
    """CTEs, to follow WITH RECURSIVE, up to `packs` (key, k, text): the parts of source (key, i, part), in the order of i,
    joined by blanks up to `most` characters; longer ones are cut by width first."""
    return f"""cut_parts AS (SELECT key, i, part, unnest(range(0, length(part), {most})) AS lo FROM ({source})),
 items AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY i, lo) AS b, substring(part, lo + 1, {most}) AS item FROM cut_parts),
 stops AS (SELECT key, b, CAST(sum(length(item) + 1) OVER (PARTITION BY key ORDER BY b) AS BIGINT) AS p FROM items UNION ALL SELECT DISTINCT key, 0, 0 FROM items),
 reach AS MATERIALIZED (SELECT key, b, max(b) OVER (PARTITION BY key ORDER BY p RANGE BETWEEN CURRENT ROW AND {most + 1} FOLLOWING) AS to_b, max(b) OVER (PARTITION BY key) AS n FROM stops),
 pack_from AS (SELECT key, 0 AS k, b, to_b, n FROM reach WHERE b = 0 UNION ALL SELECT r.key, k + 1, r.b, r.to_b, r.n FROM pack_from q JOIN reach r ON r.key = q.key AND r.b = q.to_b WHERE q.to_b < q.n),
 packs AS (SELECT f.key, f.k, string_agg(item, ' ' ORDER BY x.b) AS text FROM pack_from f JOIN items x ON x.key = f.key AND x.b > f.b AND x.b <= f.to_b GROUP BY f.key, f.k)"""


#: Macro-like expressions: the CRC-32 of a word's UTF-8 bytes.
_BYTES = "[strpos('0123456789ABCDEF', h[2 * j + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * j + 2]) - 17 FOR j IN range(length(h) // 2)]"
_CRC_STEP = "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
_CRC = f"xor(list_reduce(flatten([[CAST(x AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN {_BYTES}]), {_CRC_STEP}, CAST(4294967295 AS BIGINT)), 4294967295)"


def semantic(source: str, threshold: float, most: int, dim: int = 64) -> str:
    """CTEs, to follow WITH RECURSIVE, up to `packs`, whose key holds (key, grp): the sentences of source (key, text), cut
    where neighbours' hashed vectors have a cosine, to six places, under the threshold, and packed."""
    return f"""cells AS (SELECT key, string_split_regex(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+') AS s FROM ({source})),
 sentences AS MATERIALIZED (SELECT key, pos, trim(sentence) AS sentence FROM (SELECT key, unnest(list_filter(s, lambda x: trim(x) <> '')) AS sentence, generate_subscripts(list_filter(s, lambda x: trim(x) <> ''), 1) AS pos FROM cells)),
 words AS MATERIALIZED (SELECT key, pos, unnest(regexp_extract_all(lower(sentence), '\\S+')) AS word FROM sentences),
 hashes AS MATERIALIZED (SELECT word, {_CRC} AS c FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words))),
 counts AS (SELECT key, pos, c % {dim} AS d, sum(CASE WHEN c & 65536 > 0 THEN 1.0 ELSE -1.0 END) AS v FROM words JOIN hashes USING (word) GROUP BY ALL),
 unit AS MATERIALIZED (SELECT key, pos, d, CAST(CAST(CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY key, pos) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS v FROM counts WHERE v <> 0),
 norms AS MATERIALIZED (SELECT key, pos, sqrt(sum(v * v)) AS n FROM unit GROUP BY key, pos),
 dots AS (SELECT a.key, a.pos, sum(a.v * b.v) AS dot FROM unit a JOIN unit b ON b.key = a.key AND b.pos = a.pos + 1 AND b.d = a.d GROUP BY a.key, a.pos),
 sims AS (SELECT s.key, s.pos, coalesce(dot / (x.n * y.n), 0) AS sim FROM sentences s LEFT JOIN dots USING (key, pos) LEFT JOIN norms x USING (key, pos) LEFT JOIN norms y ON y.key = s.key AND y.pos = s.pos + 1),
 grouped AS (SELECT key, pos, coalesce(sum(CASE WHEN round(sim, 6) < {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM sims),
 {packed("SELECT {'key': key, 'grp': grp} AS key, pos AS i, sentence AS part FROM sentences JOIN grouped USING (key, pos)", most)}"""
