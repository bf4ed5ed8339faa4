"""Text, page and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, html, pii, text
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import windows as W
from ..sources.tables import load
from . import pages as page_sql
from . import personal, splitting
from .base import query

_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^가-힣a-zA-Z0-9\s!@#\$%\^&\*\(\)_\-\+=\[\]\{\}\|\\:;"''<>,\.\?/`~ㅇ·]', '', 'g'),
 '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g'), '\n?\s*-\s*[0-9]+\s*-\s*\n?', E'\n', 'g'), '!\[image\]\(/image/placeholder\)', '', 'g')"""


@query(f"SELECT doc_id, sha256({_CLEAN}) AS hash, length({_CLEAN}) AS n FROM documents")
def cleansed_text(spark, d):
    clean = load(spark, d, "documents").select("doc_id", text.cleansed("text").alias("t"))
    return clean.select("doc_id", F.sha2("t", 256).alias("hash"), F.length("t").cast("bigint").alias("n"))


@query("""WITH n AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS chunk_index FROM documents)
 SELECT doc_id, chunk_index, substring(text, chunk_index * 1000 + 1, 1000) AS text FROM n""")  # fmt: skip
def plain_chunks(spark, d):
    return chunking.plain_chunks(load(spark, d, "documents"), 1_000, "doc_id")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> '')) AS n FROM documents")
def sentence_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(text.sentences("text")).cast("bigint").alias("n"))


@query(r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.5) AS BIGINT) AS tokens, round(len(regexp_extract_all(text, '\S+')) / 1000 * 0.0001, 9) AS cost, round(n_chars / 1000 * 0.00015 + doc_id / 1000 * 0.0006, 9) AS summary FROM documents")
def token_costs(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", S.token_estimate("text").alias("tokens"), F.round(S.embedding_cost(S.n_words("text")), 9).alias("cost"), F.round(S.summary_cost("n_chars", "doc_id"), 9).alias("summary")
    )


_KINDS = {k: p for k, p, _ in pii.PATTERNS if k in ("email", "phone", "credit_card", "business_id", "account")}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _KINDS.items()) + " FROM documents")
def pii_pattern_counts(spark, d):
    return load(spark, d, "documents").select("doc_id", *[pii.count_kind(k).alias(k) for k in _KINDS])


@query(personal.MASKED)
def pii_masked(spark, d):
    return pii.anonymized(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", "clean_text", F.size("matches").alias("n"))


@query(personal.PSEUDONYMS)
def pii_pseudonyms(spark, d):
    return pii.anonymized(load(spark, d, "documents").select("doc_id", "text"), strategy="pseudonymize").select("doc_id", "clean_text")


@query(personal.by_strategy({"en": ("generalize", pii.ENABLED), "fr": ("none", ()), "de": ("risk", ("email", "phone"))}, ("mask", pii.ENABLED)))
def pii_generalised(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("file_type"))
    rows = [("en", "generalize", None), ("fr", "none", None), ("de", "risk", ["email", "phone"])]
    config = spark.createDataFrame(rows, "file_type string, strategy string, kinds array<string>")
    return pii.anonymized(pii.with_strategy(docs, config), strategy_col="strategy", kinds_col="kinds").select("doc_id", "clean_text")


@query("""WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS b FROM customer)
 SELECT c_custkey, CAST(substring(b, 3, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substring(b, 5, 2) AS INT) BETWEEN 1 AND 31 AND c_custkey % 9 <> 0 AS valid FROM n""")  # fmt: skip
def resident_id_check(spark, d):
    """Resident numbers made from keys; every ninth is a digit short."""
    k = F.col("c_custkey")
    birth = F.lpad((k * 7919 % 1_000_000).cast("string"), 6, "0")
    number = F.concat(birth, F.lit("-"), F.when(k % 9 == 0, "123456").otherwise("1234567"))
    return load(spark, d, "customer").select("c_custkey", S.resident_id_date_valid(number).alias("valid"))


@query(personal.LOG)
def pii_log(spark, d):
    return pii.match_rows(pii.anonymized(load(spark, d, "documents").select("doc_id", "text")), "doc_id")


@query(personal.NUMBERS)
def pii_numbered(spark, d):
    return W.pseudonym_numbers(pii_log(spark, d), doc="doc_id").select("doc_id", "type", "start", "number")


@query(personal.COUNTS)
def pii_type_counts(spark, d):
    return A.pii_counts(pii_log(spark, d))


@query(personal.RISKS)
def pii_risk_summary(spark, d):
    return A.pii_summary(pii_log(spark, d))


_LUHN = """WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{16}')) AS v FROM documents), x AS (SELECT row_number() OVER () AS r, doc_id, v FROM n),
 d AS (SELECT r, doc_id, v, unnest(range(16)) AS i FROM x), e AS (SELECT r, doc_id, v, i, CAST(substring(v, 16 - i, 1) AS INT) AS c FROM d)
 SELECT doc_id, v AS value, sum(CASE WHEN i % 2 = 0 THEN c WHEN c < 5 THEN 2 * c ELSE 2 * c - 9 END) % 10 = 0 AS valid FROM e GROUP BY r, doc_id, v"""


@query(_LUHN)
def luhn_check(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{16})"), F.lit(1))).alias("value"))
    return rows.withColumn("valid", S.luhn_valid("value"))


@query(page_sql.MARKDOWN)
def page_markdown(spark, d):
    return html.page_texts(load(spark, d, "pages"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(spark, d):
    return html.titles(load(spark, d, "pages"))


def _pages(spark, d):
    """Documents as pages of one line break each."""
    lines = F.posexplode(F.split("text", "\n"))
    return load(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("hash_sha256"), lines.alias("page_number", "text")).withColumn("n_images", (F.col("doc") % 4).cast("bigint"))


_PAGES = "SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS page_number FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"


@query(f"""WITH RECURSIVE {splitting.pieces(f"SELECT {{'doc': doc_id, 'page': page_number}} AS key, text FROM ({_PAGES})", 200, 20)}
 SELECT key.doc AS hash_sha256, CAST(key.page AS INT) AS page_number, row_number() OVER (PARTITION BY key.doc ORDER BY key.page, path, k) - 1 AS chunk_index, text FROM pieces""")
def recursive_chunks(spark, d):
    return chunking.fixed_chunks(_pages(spark, d), 200, 20)


_LETTERS = r"SELECT doc_id AS doc, length(regexp_replace(text, '\s', '', 'g')) AS letters FROM documents WHERE regexp_matches(text, '\S')"


def _letters(chunks):
    return chunks.groupBy(F.col("hash_sha256").alias("doc")).agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters"))


@query(_LETTERS)
def chunk_letters(spark, d):
    """Chunks without overlap hold every character of their pages but white space, once."""
    return _letters(chunking.fixed_chunks(_pages(spark, d), 200, 0))


@query(_LETTERS)
def semantic_letters(spark, d):
    """The same of chunks that end where the meaning changes."""
    return _letters(chunking.semantic_chunks(_pages(spark, d), 0.5, 500))


@query(f"""WITH RECURSIVE {splitting.semantic(f"SELECT {{'doc': doc_id, 'page': page_number}} AS key, text FROM ({_PAGES})", 0.5, 500)}
 SELECT key.key.doc AS hash_sha256, CAST(key.key.page AS INT) AS page_number, row_number() OVER (PARTITION BY key.key.doc ORDER BY key.key.page, key.grp, k) - 1 AS chunk_index, text FROM packs""")
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(_pages(spark, d), 0.5, 500)


@query(r"SELECT doc_id AS doc, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''), E'\n\n'), '') AS text FROM documents WHERE trim(text, E' \n') <> ''")
def merged_pages(spark, d):
    return A.merged_text(_pages(spark, d))


@query("""WITH p AS (SELECT doc_id AS doc, doc_id % 4 AS im, unnest(string_split(text, chr(10))[1:10]) AS t FROM documents), a AS (SELECT doc, count(*) AS pages, count(*) FILTER (length(trim(t)) > 50) AS f,
 coalesce(sum(length(trim(t))) FILTER (length(trim(t)) > 50), 0) AS chars, sum(im) AS images FROM p GROUP BY 1)
 SELECT doc, f / pages < 0.3 OR chars / pages < 100 OR (images / pages > 2 AND chars / pages < 200) AS needs_ocr FROM a""")  # fmt: skip
def ocr_needed(spark, d):
    return A.needs_ocr(_pages(spark, d))


@query("SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS INT) AS page_number, string_agg(l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1, 2")
def page_elements(spark, d):
    li = load(spark, d, "lineitem")
    return A.page_elements(li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("int").alias("page_number"), F.col("l_linenumber").alias("element"), F.col("l_returnflag").alias("text")))


@query("""SELECT l_orderkey AS doc, CASE WHEN avg(round(l_discount * 100)) < 4.51 THEN '' ELSE trim(string_agg(l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) ELSE ' ' END, '' ORDER BY l_linenumber, l_returnflag), E' \n') END AS text
 FROM lineitem GROUP BY 1""")  # fmt: skip
def confident_text(spark, d):
    li = load(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("field"), F.col("l_returnflag").alias("text"), (F.col("l_linenumber") % 3 == 0).alias("line_break"), F.round(F.col("l_discount") * 100).alias("confidence"))
    return A.gated_text(rows, 4.51).select("doc", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


# ---- names, dates, cells --------------------------------------------------------------------------------------------


@query("SELECT doc_id, source || '_' || doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'unknown' END AS suffix, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'general' END AS category FROM documents")
def file_names(spark, d):
    base = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/in/a.b/"), base, F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(""))
    route = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("file.uploaded."), "source")).otherwise("other")
    return load(spark, d, "documents").select("doc_id", S.stem(path).alias("stem"), S.suffix(path).alias("suffix"), S.routing_category(route).alias("category"))


@query("SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) - 32400 AS first, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + 53999 AS last, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + 3600 AS epoch FROM orders")
def seoul_days(spark, d):
    first, last = S.seoul_bounds("day")
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    iso = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T01:00:00Z"))
    return rows.select("o_orderkey", first.alias("first"), last.alias("last"), S.iso_epoch(iso).alias("epoch"))


@query("SELECT c_custkey, '| ' || c_name || ' | ' || c_mktsegment || '\\|x |' AS line, CASE WHEN c_custkey % 2 = 0 THEN '컬럼1' ELSE c_name END AS first FROM customer")
def markdown_rows(spark, d):
    c = load(spark, d, "customer")
    head = S.header_names(F.array(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name")), F.lit("b")))
    return c.select("c_custkey", S.markdown_row(F.array("c_name", F.concat("c_mktsegment", F.lit("|x")))).alias("line"), F.element_at(head, 1).alias("first"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '**' || c_name || 'b**' WHEN 1 THEN 'a ' || c_name WHEN 2 THEN '**' || c_name || '** c' WHEN 3 THEN '**' || c_name || '**' WHEN 4 THEN '**' || c_name || ' d**' ELSE c_name END AS text FROM customer")
def bold_repair(spark, d):
    """Bold runs side by side, empty ones, blanks before closing marks, odd runs of stars, blanks alone."""
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("**"), "c_name", F.lit("****b**"))).when(k == 1, F.concat(F.lit("a ** ** "), "c_name")).when(k == 2, F.concat(F.lit("**"), "c_name", F.lit("  ** c")))
    raw = raw.when(k == 3, F.concat(F.lit("***"), "c_name", F.lit("***"))).when(k == 4, F.concat(F.lit("**"), "c_name", F.lit("**** d**"))).otherwise(F.concat(F.lit(" \n "), "c_name", F.lit("\t")))
    return load(spark, d, "customer").select("c_custkey", S.repair_bold(raw).alias("text"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey + 0.5 AS VARCHAR) END WHEN 1 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d 00:00:00')
 WHEN 2 THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d') WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END ELSE CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE '' END END AS shown FROM orders""")  # fmt: skip
def cell_texts(spark, d):
    k, n, day = F.col("o_orderkey") % 5, F.col("o_custkey"), F.col("o_orderdate").cast("date")
    number = F.when(k == 0, F.when(n % 2 == 0, n.cast("double")).otherwise(n + 0.5))
    text = F.when((k == 4) & (n % 2 == 0), F.concat(F.lit(" \n"), "o_orderstatus", F.lit("\t")))
    shown = S.cell_text(number, F.when(k == 1, day.cast("timestamp_ntz")), F.when(k == 2, day), F.when(k == 3, n % 2 == 0), text)
    return load(spark, d, "orders").select("o_orderkey", shown.alias("shown"))


_NAME = "replace(p_name, '-', '\\-') || '\\- x\\|y'"


@query(rf"""WITH r AS (SELECT p_partkey, p_partkey % 10 < 5 AS gone, p_partkey % 7 = 0 AS thin, CASE WHEN p_partkey % 10 >= 5 AND p_partkey % 20 >= 10 THEN 'k' ELSE '' END AS first, {_NAME} AS name, CAST(p_size AS VARCHAR) AS size FROM part)
 SELECT p_partkey, CASE WHEN NOT gone THEN first || ',' ELSE '' END || CASE WHEN thin THEN '\-,' ELSE name || ',' || size END AS cells FROM r WHERE NOT thin OR first = 'k'""")  # fmt: skip
def table_cells(spark, d):
    """Ten tables of parts: in five the first column is blank in every row, in the others in half of them; every seventh row holds dashes and blanks."""
    k = F.col("p_partkey")
    first = F.when(k % 10 < 5, " ").when(k % 20 >= 10, "k")
    row = F.when(k % 7 == 0, F.array(first, F.lit(" - "), F.lit(""))).otherwise(F.array(first, F.concat("p_name", F.lit("-\nx|y")), F.col("p_size").cast("string")))
    rows = load(spark, d, "part").select((k % 10).alias("sheet"), "p_partkey", row.alias("cells"))
    return S.clean_tables(rows).select("p_partkey", F.array_join("cells", ",").alias("cells"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1500 ELSE 500 END AS chunk_size, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 50 END AS chunk_overlap FROM documents")
def chunk_settings(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "semantic").otherwise("fixed")
    null = F.lit(None).cast("int")
    return load(spark, d, "documents").select("doc_id", S.chunk_settings(kind, null, null, null).alias("s")).select("doc_id", "s.*")


@query("SELECT c_custkey, c_mktsegment || ': ' || c_name || '. ' || c_mktsegment || ', x' AS text FROM customer")
def entity_texts(spark, d):
    return load(spark, d, "customer").select("c_custkey", S.entity_text("c_mktsegment", "c_name", F.array("c_mktsegment", F.lit("x"))).alias("text"))


@query("SELECT string_agg(n_nationkey || '(' || n_name || ')', ', ' ORDER BY n_nationkey) AS text FROM nation")
def dictionary_text(spark, d):
    return S.dictionary_text(load(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query(f"SELECT '{S.DEFAULT_TYPES}' AS text")
def dictionary_default(spark, d):
    """What is shown where no entry is visible."""
    return S.dictionary_text(load(spark, d, "nation").where("n_nationkey < 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query(f"""SELECT c_custkey, '{S.EVIDENCE}' || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN '{S.NO_EVIDENCE}' ELSE '- ' || c_name || chr(10) || '- z' END || chr(10) || chr(10) || '{S.QUESTION}' || chr(10) || c_mktsegment AS text FROM customer""")
def evidence_texts(spark, d):
    blank, null = F.lit(" \n"), F.lit(None).cast("string")
    full = F.array(F.concat(F.lit("\t"), "c_name", F.lit(" ")), blank, null, F.lit("z "))
    ctx = F.when(F.col("c_custkey") % 10 == 0, F.array(blank, null)).when(F.col("c_custkey") % 5 != 0, full)
    return load(spark, d, "customer").select("c_custkey", S.evidence_text(ctx, "c_mktsegment").alias("text"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'c' || o_custkey || ',' END || 'd' AS contexts, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '3,' END || CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE '4' END AS pages,
 (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS errors FROM orders WHERE o_orderkey % 11 <> 0""")  # fmt: skip
def golden_items(spark, d):
    """Items with up to three pairs of context and page as arrays, blank ones left out; rows without an id are no items."""
    i = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(
        F.when(i % 11 != 0, i).alias("id"), F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("c1"), F.when(i % 3 != 0, "3").alias("p1"), F.lit("d").alias("c2"),
        F.when(i % 5 == 0, "1.5").otherwise("4").alias("p2"), F.lit(None).cast("string").alias("c3"), F.lit("").alias("p3"),
    )
    got = S.golden_items(rows, ["c1", "c2", "c3"], ["p1", "p2", "p3"])
    return got.select("id", F.array_join("reference_contexts", ",").alias("contexts"), F.array_join(F.transform("reference_pages", lambda x: x.cast("string")), ",").alias("pages"), F.size("errors").alias("errors"))


@query("""SELECT o_orderkey, (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS errors FROM orders""")
def golden_item_errors(spark, d):
    i = F.col("o_orderkey")
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.when(i % 3 == 0, " ").otherwise("c").alias("c1"), F.when(i % 3 != 0, "3").alias("p1"), F.lit("d").alias("c2"), F.when(i % 5 == 0, "1.5").otherwise("4").alias("p2")
    )
    return rows.select("o_orderkey", F.size(S.context_errors(["c1", "c2"], ["p1", "p2"])).alias("errors"))


def _responses(spark, d):
    i = F.col("o_orderkey")
    body = F.concat(F.lit('{"entities":[{"name":" n'), (i % 50).cast("string"), F.lit('","type":"Person"},{"name":"","type":"person"},{"name":"q","type":"ghost"}],"relations":[{"source":"a","type":"KNOWS","target":"n'), (i % 50).cast("string"), F.lit('"},{"source":"a"}]}'))
    fenced = F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))
    return load(spark, d, "orders").select(i.alias("id"), F.when(i % 4 == 0, body).when(i % 4 == 1, fenced).when(i % 4 == 2, "null").otherwise("{bad").alias("response"))


@query("SELECT o_orderkey AS id, 'n' || (o_orderkey % 50) AS name, 'person' AS type FROM orders WHERE o_orderkey % 4 < 2")
def response_entities(spark, d):
    return S.graph_rows(_responses(spark, d), ["person", "place"])[0]


@query("SELECT o_orderkey AS id, 'a' AS source, 'knows' AS type, 'n' || (o_orderkey % 50) AS target FROM orders WHERE o_orderkey % 4 < 2")
def response_relations(spark, d):
    return S.graph_rows(_responses(spark, d), ["person"])[1]


@query("SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'plain ' || o_custkey WHEN 1 THEN 'in' || o_custkey WHEN 2 THEN 'a' || chr(10) || o_custkey WHEN 3 THEN 'q ' || o_custkey WHEN 4 THEN '{\"text\":' || o_custkey END AS answer FROM orders")
def answer_texts(spark, d):
    """Plain and quoted strings, objects and lists with and without text, broken JSON, JSON's null, blanks."""
    k, n = F.col("o_orderkey") % 10, F.col("o_custkey").cast("string")
    made = {0: (" plain ", "\n"), 1: ('{"x":1,"text":" in', ' "}'), 2: ('[{"text":"a"},{"x":1},{"text":""},3,{"text":"', '"}]'), 3: ('"q ', '  "'), 4: ('{"text":', ""), 5: ('{"content":"', '"}'), 6: ('[{"content":"', '"}]'), 7: ('{"text":', "}")}
    body = F.when(k == 8, "null").when(k == 9, " \t")
    for m, (before, after) in made.items():
        body = body.when(k == m, F.concat(F.lit(before), n, F.lit(after)))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.answer_text(body).alias("answer"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN '{"a":{"Token":"[FILTERED]","b":[{"password":"[FILTERED]","n":[1,2.5,null,true]}]},"PRIVATE_KEY":"[FILTERED]","passport":"p","c":' || o_orderkey || '}' END AS clean FROM orders""")
def nested_redaction(spark, d):
    """Secrets of every shape: scalars, objects, arrays; every seventh row is no object."""
    i = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"a":{"Token":["t",{"x":1}],"b":[{"password" : {"x":"p"}, "n":[1,2.5,null,true]}]},"PRIVATE_KEY":null,"passport":"p","c":'), i, F.lit("}"))
    other = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), i, F.lit("]"))).otherwise("{broken")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), S.redact_nested(F.when(F.col("o_orderkey") % 7 == 0, other).otherwise(body)).alias("clean"))


def _cells(spark, d):
    """Line items as a sheet for each ship mode: a title row, a header row, values."""
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("sheet"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    row = F.col("l_orderkey") * 8 + F.col("l_linenumber") + 2
    body = li.select("sheet", row.alias("row"), F.posexplode(F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.lit(""))).alias("col", "value"))
    modes = li.select("sheet").distinct()
    top = modes.select("sheet", F.lit(0).cast("bigint").alias("row"), F.posexplode(F.array(F.lit("Report"), F.lit(""), F.lit(""))).alias("col", "value"))
    head = modes.select("sheet", F.lit(1).cast("bigint").alias("row"), F.posexplode(F.array(F.lit("quantity"), F.lit("price"), F.lit(""))).alias("col", "value"))
    return body.union(top).union(head)


@query("SELECT DISTINCT l_returnflag AS sheet, CAST(1 AS BIGINT) AS \"row\", 2 AS width FROM lineitem")
def header_rows(spark, d):
    cells = _cells(spark, d)
    return W.header_row(cells).join(W.used_width(cells, 1), "sheet").select("sheet", "row", "width")


@query("""WITH RECURSIVE l AS (SELECT l_returnflag AS sheet, l_orderkey * 8 + l_linenumber AS o, '| ' || CAST(l_quantity AS VARCHAR) || ' | ' || CAST(l_extendedprice AS VARCHAR) || ' |' AS line FROM lineitem),
 r AS (SELECT sheet, line, length(line) + 1 AS n, row_number() OVER (PARTITION BY sheet ORDER BY o, line) - 1 AS i FROM l),
 c AS (SELECT sheet, line, n, i, CAST(sum(n) OVER (PARTITION BY sheet ORDER BY i) AS BIGINT) AS total FROM r),
 h AS (SELECT chr(10) || chr(10) || '| quantity | price |' || chr(10) || '| --- | --- |' || chr(10) AS head),
 w AS (SELECT c.*, 2000 - length('# ' || sheet || head) AS room FROM c, h),
 e AS (SELECT sheet, i, max(i) OVER (PARTITION BY sheet ORDER BY total RANGE BETWEEN CURRENT ROW AND room - n FOLLOWING) AS last FROM w),
 s AS (SELECT sheet, CAST(0 AS BIGINT) AS k, i, last FROM e WHERE i = 0 UNION ALL SELECT e.sheet, k + 1, e.i, e.last FROM s JOIN e ON e.sheet = s.sheet AND e.i = s.last + 1)
 SELECT s.sheet, k AS chunk_index, '# ' || s.sheet || CASE WHEN k > 0 THEN ' (Part ' || (k + 1) || ')' ELSE '' END || any_value(head) || string_agg(line, chr(10) ORDER BY c.i) AS text,
 count(*) AS row_count, 'markdown_table' AS type FROM s JOIN c ON c.sheet = s.sheet AND c.i BETWEEN s.i AND s.last CROSS JOIN h GROUP BY s.sheet, k""")  # fmt: skip
def table_chunks(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("cells"))
    return chunking.table_chunks(li, ["quantity", "price"], 2_000)


@query("""SELECT l_suppkey AS doc, 1 AS page_number, CAST(floor((l_partkey + 5) / 100) AS BIGINT) AS gx, CAST(floor((l_quantity * 4 + 10) / 100) AS BIGINT) AS gy, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2, 3, 4
 HAVING count(*) >= 5 AND max(l_partkey + 10) - min(l_partkey) > 50 AND max(l_quantity * 4 + 20) - min(l_quantity * 4) > 50""")  # fmt: skip
def chart_regions(spark, d):
    """Line items as boxes; those of line 7 are of no width."""
    li = load(spark, d, "lineitem")
    x, y = F.col("l_partkey").cast("double"), F.col("l_quantity").cast("double") * 4
    wide = F.when(F.col("l_linenumber") == 7, 1.0).otherwise(10.0)
    e = li.select(F.col("l_suppkey").alias("doc"), F.lit(1).alias("page_number"), x.alias("x0"), y.alias("y0"), (x + wide).alias("x1"), (y + 20).alias("y1"))
    return chunking.chart_regions(e).select("doc", "page_number", "gx", "gy", "n")
