"""SQL for pages whose content is an article of headings, paragraphs, bold stretches and line breaks, closed or not."""

from __future__ import annotations


def _decoded(text: str) -> str:
    """The text with the entities that the pages hold; their semicolon may be missing."""
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


#: One letter for each kind of element, and what stands before and after it.
_KIND = r"CASE WHEN regexp_matches(token, '^</?p\b') THEN 'p' WHEN regexp_matches(token, '^</?(b|strong)\b') THEN 'b' WHEN regexp_matches(token, '^</?h1\b') THEN 'h' WHEN regexp_matches(token, '^<br\b') THEN 'n' ELSE '' END"
_OPENED = "CASE kind WHEN 'p' THEN E'\\n\\n' WHEN 'h' THEN E'\\n\\n# ' WHEN 'b' THEN '**' WHEN 'n' THEN E'\\n' ELSE '' END"


def _closed(letters: str) -> str:
    """What is written when elements close, the innermost last in letters."""
    return f"replace(replace(replace(reverse({letters}), 'b', '**'), 'p', E'\\n\\n'), 'h', E'\\n\\n')"


_FROM = "(length(open) - strpos(reverse(open), kind) + 1)"
#: Tokens are read one after another with the letters of the elements that are open: a paragraph closes one that is
#: directly around it, the end of an element closes all in it, the end of the article all.
MARKDOWN = rf"""WITH RECURSIVE own AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
 listed AS (SELECT page_id, regexp_extract_all(article, '(?s)<!--.*?-->|<[^>]*>|[^<]+') AS tokens FROM own),
 tokens AS (SELECT page_id, token, i, starts_with(token, '<') AS tag, starts_with(token, '</') AS ends, {_KIND} AS kind FROM (SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM listed)),
 state AS (SELECT page_id, CAST(0 AS BIGINT) AS i, '' AS open, '' AS done FROM own UNION ALL
  SELECT page_id, t.i, CASE WHEN NOT tag OR kind IN ('', 'n') THEN open WHEN ends THEN CASE WHEN contains(open, kind) THEN left(open, CAST({_FROM} - 1 AS BIGINT)) ELSE open END
    WHEN kind = 'p' AND right(open, 1) = 'p' THEN open ELSE open || kind END,
   done || CASE WHEN NOT tag THEN regexp_replace({_decoded("token")}, '\s+', ' ', 'g') WHEN kind = '' THEN '' WHEN ends THEN CASE WHEN contains(open, kind) THEN {_closed(f"substring(open, CAST({_FROM} AS BIGINT))")} ELSE '' END
    WHEN kind = 'p' AND right(open, 1) = 'p' THEN E'\n\n' || {_OPENED} ELSE {_OPENED} END
  FROM state s JOIN tokens t USING (page_id) WHERE t.i = s.i + 1),
 whole AS (SELECT page_id, arg_max(done || {_closed("open")}, i) AS t FROM state GROUP BY page_id)
 SELECT page_id, trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
  {_decoded("regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)")} AS description,
  trim(regexp_replace(regexp_replace(t, '[ \t]*\n[ \t]*', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n') AS text FROM own JOIN whole USING (page_id)"""
