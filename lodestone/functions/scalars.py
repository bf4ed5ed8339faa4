"""Row functions on strings, dates, numbers, arrays and JSON, as Columns that stay inside code generation."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RESPONSE
from .schedules import next_due

SEOUL = "Asia/Seoul"
SEOUL_S = 9 * 3600  # no daylight saving


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- names and routes ---------------------------------------------------------------------------------------------


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """The file name without its last suffix; a name that only begins with a dot is all stem."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).otherwise(name)


def suffix(path: Column | str, default: str = "unknown") -> Column:
    """The last suffix without its dot, lower-cased; the default without one."""
    got = F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]+)$", 1))
    return F.when(got == "", default).otherwise(F.coalesce(got, F.lit(default)))


def routing_category(key: Column | str, default: str = "general") -> Column:
    """file.uploaded.X gives X."""
    got = F.regexp_extract(F.coalesce(_c(key), F.lit("")), r"^file\.uploaded\.(.+)$", 1)
    return F.when(got == "", default).otherwise(got)


def template_regex(template: Column | str) -> Column:
    """A path template with {name} parts as a regular expression for the whole path."""
    quoted = F.regexp_replace(_c(template), r"([\\.+*?\[\]^$()|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\{[^}/]+\}", "[^/]+"), F.lit("$"))


def match_templates(rows: DataFrame, templates: DataFrame, path: str = "endpoint", most: int = 1_000) -> DataFrame:
    """rows with the template that their path fits (the least by name, null if none). templates: (template), at most `most`.

    The templates become conditions of one expression, so that rows are neither shuffled nor multiplied.
    """
    names = [r.template for r in templates.select("template").distinct().orderBy(F.desc("template")).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} templates")
    out = F.lit(None).cast("string")
    for t in names:
        out = F.when(F.regexp_like(F.col(path), template_regex(F.lit(t))), F.lit(t)).otherwise(out)
    return rows.withColumn("template", out)


def action_type(method: Column | str, path: Column | str) -> Column:
    """The kind of a request: by words in its path, whatever their case, else by its method; UNKNOWN for other methods."""
    m, p = _c(method), _c(path)
    low = F.lower(p)
    out = F.when(low.contains("search") | low.contains("retrieval"), "SEARCH").when(low.contains("upload"), "UPLOAD").when(low.contains("download"), "DOWNLOAD")
    out = out.when(low.contains("websocket") | p.startswith("/notifications/"), "WEBSOCKET")
    return out.when(m == "GET", "READ").when(m == "POST", "CREATE").when(m.isin("PUT", "PATCH"), "UPDATE").when(m.isin("DELETE", "WEBSOCKET"), m).otherwise("UNKNOWN")


def outcome(code: Column | str) -> Column:
    return F.when(_c(code).between(200, 399), "SUCCESS").otherwise("FAILED")


# ---- dates ---------------------------------------------------------------------------------------------------------


def seoul_date(epoch: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(_c(epoch)), SEOUL))


def seoul_bounds(day: Column | str) -> tuple[Column, Column]:
    """Epoch seconds of 00:00:00 and 23:59:59 of a date in Seoul."""
    start = F.unix_date(_c(day).cast("date")).cast("bigint") * 86_400 - SEOUL_S
    return start, start + 86_399


def calendar(spark, start: str, end: str) -> DataFrame:
    """(date) from start to end, both included."""
    if start > end:
        raise ValueError("the range ends before it starts")
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))


def iso_epoch(text: Column | str) -> Column:
    """Epoch seconds of an ISO-8601 time; a Z at its end means UTC. Null for what is no time."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(_c(text), "Z$", "+00:00")))


def next_time(cron: Column | str, now: int) -> Column:
    """Epoch seconds after `now` (UTC) at which a schedule of five fields is due; null for other schedules, and for none."""
    return next_due(_c(cron), now)


# ---- numbers -------------------------------------------------------------------------------------------------------


def finite(x: Column | str) -> Column:
    """NaN and infinities as null."""
    c = _c(x).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def token_estimate(text: Column | str) -> Column:
    return F.floor(n_words(text) * 1.5).cast("bigint")


def n_words(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+")).cast("bigint")


def embedding_cost(tokens: Column | str, price: Column | str | None = None) -> Column:
    t = _c(tokens)
    fallback = t / 1000 * 0.0001
    return fallback if price is None else F.coalesce(t * _c(price), fallback)


def summary_cost(prompt: Column | str, completion: Column | str) -> Column:
    return _c(prompt) / 1000 * 0.00015 + _c(completion) / 1000 * 0.0006


def luhn_valid(digits: Column | str) -> Column:
    """Whether the digits in a text pass the Luhn test (no digit: false)."""
    d = F.reverse(F.split(F.regexp_replace(_c(digits), "[^0-9]", ""), ""))
    d = F.filter(d, lambda x: x != "")
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") < 5, x.cast("int") * 2).otherwise(x.cast("int") * 2 - 9)))
    return (F.size(d) > 0) & (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def resident_id_date_valid(value: Column | str) -> Column:
    """Month 1-12 and day 1-31 of a resident number of 13 digits."""
    d = F.regexp_replace(_c(value), "[^0-9]", "")
    return (F.length(d) == 13) & d.substr(3, 2).cast("int").between(1, 12) & d.substr(5, 2).cast("int").between(1, 31)


def with_price(df: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """df with the price of its model: the exact name, else, for provider/name, the first model (by name) of this provider
    in whose own name the part after the first slash occurs; null without either.

    models: (model_name, provider, input_cost_per_token).
    """
    from ..operators.joins import small

    exact = models.groupBy(F.col("model_name").alias(model)).agg(F.min("input_cost_per_token").alias("_exact"))
    names = df.select(model).distinct().where(F.col(model).contains("/"))
    split = names.select(model, F.substring_index(model, "/", 1).alias("provider"), F.regexp_replace(model, r"^[^/]*/", "").alias("_base"))
    part = split.join(small(models), "provider").where(F.col("model_name").contains(F.col("_base")))
    part = part.groupBy(model).agg(F.min_by("input_cost_per_token", "model_name").alias("_part"))
    out = df.join(small(exact), model, "left").join(part, model, "left")
    return out.withColumn("price", F.coalesce("_exact", "_part")).drop("_exact", "_part")


# ---- arrays and text parts ------------------------------------------------------------------------------------------


def ordered_union(a: Column | str, b: Column | str) -> Column:
    return F.array_distinct(F.array_union(_c(a), _c(b)))


def markdown_row(cells: Column | str) -> Column:
    """| a | b |, with pipes escaped and nulls blank."""
    clean = F.transform(_c(cells), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"))
    return F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |"))


def header_names(headers: Column | str, word: str = "컬럼") -> Column:
    """Blank headers get a name with their place, from 1."""
    return F.transform(_c(headers), lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit(word), (i + 1).cast("string"))).otherwise(h))


def repair_bold(text: Column | str) -> Column:
    """Markdown whose bold runs are in order.

    The text is taken apart at its marks (two stars; the odd one of a run of stars belongs to its last mark), so that every
    second piece is bold. Bold pieces with nothing or only blanks between them become one; empty ones leave a blank; marks
    touch their text; a mark without a partner goes if only blanks follow. Blanks are single, none at the ends.
    """
    pieces = F.split(_c(text), r"\*\*(?:\*(?!\*))?")
    last = F.size(pieces) - 1
    bare = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    numbered = F.transform(pieces, lambda x, i: F.struct(x.alias("raw"), bare(x).alias("bare"), ((i % 2 == 1) & (i < last)).alias("bold"), ((i % 2 == 1) & (i == last)).alias("open")))

    def add(done: Column, piece: Column) -> Column:
        """done: the text so far, and whether the bold piece at its end had a blank at its own end, which shows if another joins it."""
        out, before = done["out"], F.rtrim(done["out"])
        gap = F.when((before != out) | done["spare"] | F.rlike(piece["raw"], F.lit(r"^\s")), " ").otherwise("")
        joined = F.concat(F.left(before, F.length(before) - 2), gap, piece["bare"], F.lit("**"))
        bold = F.when(piece["bare"] == "", F.concat(out, F.lit(" "))).when(F.endswith(before, F.lit("**")), joined).otherwise(F.concat(out, F.lit("**"), piece["bare"], F.lit("**")))
        alone = F.when(piece["bare"] == "", out).otherwise(F.concat(out, F.lit("**"), piece["raw"]))
        text = F.when(piece["bold"], bold).when(piece["open"], alone).otherwise(F.concat(out, F.regexp_replace(piece["raw"], r"\s+", " ")))
        spare = (piece["bold"] & F.rlike(piece["raw"], F.lit(r"\s$"))) | (~piece["bold"] & (piece["raw"] == "") & done["spare"])
        return F.struct(text.alias("out"), spare.alias("spare"))

    whole = F.aggregate(numbered, F.struct(F.lit("").alias("out"), F.lit(False).alias("spare")), add, lambda d: d["out"])
    return F.trim(F.regexp_replace(whole, r"\s+", " "))


def entity_text(kind: Column | str, description: Column | str, synonyms: Column | str) -> Column:
    return F.concat(_c(kind), F.lit(": "), _c(description), F.lit(". "), F.array_join(_c(synonyms), ", "))


#: The headings of a question with its evidence, and the line where there is none.
EVIDENCE, NO_EVIDENCE, QUESTION = "[근거]", "- (제공된 근거 없음)", "[질문]"


def evidence_text(contexts: Column | str, question: Column | str) -> Column:
    """A question under its evidence: a line for each text of an array<string>, blank ones left out."""
    stripped = F.transform(_c(contexts), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    lines = F.array_join(F.transform(F.filter(stripped, lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    shown = F.when(F.coalesce(lines, F.lit("")) == "", NO_EVIDENCE).otherwise(lines)
    return F.concat_ws("\n", F.lit(EVIDENCE), shown, F.lit(""), F.lit(QUESTION), _c(question))


#: Fixed value: the dictionary that is shown where none has been made.
DEFAULT_TYPES = "person(인물), organization(조직), project(프로젝트), location(장소), event(이벤트), concept(개념), document(문서), date(날짜)"


def dictionary_text(rows: DataFrame, key: str = "key", name: str = "name", default: str = DEFAULT_TYPES, most: int = 10_000) -> DataFrame:
    """(text): `key(name), ...` by key; the default for an empty dictionary. One text: more than `most` rows (counted) are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a dictionary has {most} rows at most")
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, name))), lambda x: F.concat(x[key], F.lit("("), x[name], F.lit(")"))), ", ")
    return rows.agg(one.alias("t")).select(F.when(F.col("t") == "", default).otherwise(F.col("t")).alias("text"))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def clean_tables(rows: DataFrame, by: str = "sheet", cells: str = "cells") -> DataFrame:
    """rows (by, ..., cells array<string>) of tables as they are shown.

    The first column goes where it is blank in every row of its table, then rows of nothing but blanks and single dashes.
    Cells are stripped, nulls blank; pipes and dashes are escaped, line breaks blanks; rows are padded to the widest.
    """
    own = F.coalesce(_stripped(F.try_element_at(cells, F.lit(1))) == "", F.lit(True)) & (F.size(cells) > 0)
    blank = rows.groupBy(by).agg(F.min(own).alias("_blank"))
    out = rows.join(blank, by).withColumn(cells, F.when(F.col("_blank"), F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))).otherwise(F.col(cells))).drop("_blank")
    out = out.where(F.exists(cells, lambda x: ~_stripped(x).isin("", "-")))
    width = out.groupBy(by).agg(F.max(F.size(cells)).alias("_width"))
    shown = F.transform(cells, lambda x: F.regexp_replace(F.translate(_stripped(x), "\n\r", "  "), r"([|-])", r"\\$1"))
    padded = F.concat(shown, F.array_repeat(F.lit(""), F.col("_width") - F.size(cells)))
    return out.join(width, by).select(*[padded.alias(cells) if c == cells else F.col(c) for c in rows.columns])


def cell_text(number: Column | str | None = None, moment: Column | str | None = None, day: Column | str | None = None, flag: Column | str | None = None, text: Column | str | None = None) -> Column:
    """A cell's value as text, by the first kind that it has: whole numbers without a decimal point, times, dates, TRUE or FALSE, texts stripped; else blank."""
    parts = []
    if number is not None:
        n = _c(number).cast("double")
        parts.append(F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string")))
    if moment is not None:
        parts.append(F.date_format(_c(moment), "yyyy-MM-dd HH:mm:ss"))
    if day is not None:
        parts.append(F.date_format(_c(day), "yyyy-MM-dd"))
    if flag is not None:
        parts.append(F.upper(_c(flag).cast("string")))
    if text is not None:
        parts.append(F.regexp_replace(_c(text), r"^\s+|\s+$", ""))
    return F.coalesce(*parts, F.lit(""))


def chunk_settings(kind: Column | str, size: Column | str, overlap: Column | str, max_size: Column | str) -> Column:
    """struct<chunk_size, chunk_overlap>: semantic chunking takes the maximal size and no overlap; defaults 500 and 50."""
    semantic = _c(kind) == "semantic"
    return F.struct(
        F.when(semantic, F.coalesce(_c(max_size), F.lit(1500))).otherwise(F.coalesce(_c(size), F.lit(500))).alias("chunk_size"),
        F.when(semantic, 0).otherwise(F.coalesce(_c(overlap), F.lit(50))).alias("chunk_overlap"),
    )


def context_errors(contexts: list[str], pages: list[str]) -> Column:
    """Array of violations of a golden item: the first pair is needed, pairs are whole, pages are positive whole numbers."""
    found = []
    for k, (c, p) in enumerate(zip(contexts, pages, strict=True), 1):
        has_c, has_p = F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, F.length(F.trim(F.coalesce(F.col(p).cast("string"), F.lit("")))) > 0
        if k == 1:
            found += [F.when(~has_c, f"{c} is missing"), F.when(~has_p, f"{p} is missing")]
        else:
            found += [F.when(has_c & ~has_p, f"{c} has no page"), F.when(has_p & ~has_c, f"{p} has no context")]
        number = F.col(p).cast("string").try_cast("double")
        found.append(F.when(has_p & (number.isNull() | (number != F.floor(number)) | (number <= 0)), f"{p} is no positive whole number"))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def golden_items(rows: DataFrame, contexts: list[str], pages: list[str], id_col: str = "id") -> DataFrame:
    """rows whose id is not null with reference_contexts array<string>, reference_pages array<int> and errors array<string> in place of
    the given columns: blank contexts and their pages are left out, in order; items with errors have them listed."""
    kept = rows.where(F.col(id_col).isNotNull())
    pairs = F.array(*[F.struct(F.col(c).alias("c"), F.col(p).cast("string").try_cast("double").cast("int").alias("p")) for c, p in zip(contexts, pages, strict=True)])
    full = F.filter(pairs, lambda x: F.length(F.trim(F.coalesce(x["c"], F.lit("")))) > 0)
    rest = [c for c in rows.columns if c not in (*contexts, *pages)]
    return kept.select(*rest, F.transform(full, lambda x: x["c"]).alias("reference_contexts"), F.transform(full, lambda x: x["p"]).alias("reference_pages"), context_errors(contexts, pages).alias("errors"))


# ---- JSON -----------------------------------------------------------------------------------------------------------

REDACTED = "[FILTERED]"
#: Keys of secrets.
SECRET_KEYS = ("password", "token", "secret", "api_key", "authorization", "refresh_token", "access_token", "private_key", "credential")


def json_object(text: Column | str) -> Column:
    """The text if it is a JSON object, else null (blank, 'null', other values, broken JSON)."""
    t = F.trim(_c(text))
    return F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)


def fenced_json(text: Column | str) -> Column:
    """The object in the first fenced json block; without one the text itself; null if neither is an object."""
    inner = F.regexp_extract(_c(text), r"(?s)```json\s*(\{.*?\})\s*```", 1)
    return json_object(F.when(inner == "", _c(text)).otherwise(inner))


def redact_flat(text: Column | str, keys: Iterable[str] = SECRET_KEYS) -> Column:
    """A flat JSON object with the values of secret keys replaced (keys compared without case)."""
    m = F.from_json(_c(text), "map<string,string>")
    return F.to_json(F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*keys), REDACTED).otherwise(v)))


def redact_nested(text: Column | str, keys: Iterable[str] = SECRET_KEYS) -> Column:
    """A JSON object with whatever stands under a secret key, at any depth, replaced; compact. Text that is no JSON object is null.

    Keys are compared without case. JSON of any depth has no fixed schema, so that a parser in Arrow batches does the work.
    """
    secret = frozenset(keys)

    def clean(x: object) -> object:
        if isinstance(x, dict):
            return {k: REDACTED if k.lower() in secret else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(t: str | None) -> str | None:
        try:
            got = json.loads(t) if t is not None else None
        except (ValueError, RecursionError):
            return None
        return json.dumps(clean(got), ensure_ascii=False, separators=(",", ":")) if isinstance(got, dict) else None

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return redacted(_c(text))


def answer_text(text: Column | str) -> Column:
    """The answer in a message: a plain or JSON string, the text of an object, or those of a list of objects on lines of their own.

    Stripped; null where nothing is left, where an object has no text that is a string, and for JSON's null.
    """
    t = _c(text)
    v = F.try_parse_json(t)
    kind = F.schema_of_variant(v)
    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull() & (x != ""))
    own = F.try_variant_get(v, "$.text", "variant")
    got = F.when(kind.startswith("ARRAY"), F.array_join(parts, "\n")).when(kind.startswith("OBJECT"), F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(v, "$.text", "string")))
    got = got.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "VOID", F.lit(None).cast("string")).otherwise(t)
    stripped = F.regexp_replace(got, r"^\s+|\s+$", "")
    return F.when(stripped != "", stripped)


def graph_rows(responses: DataFrame, types: Iterable[str], id_col: str = "id", text_col: str = "response") -> tuple[DataFrame, DataFrame]:
    """(id, name, type) and (id, source, type, target) of response texts; unknown types and rows with gaps are dropped."""
    parsed = responses.select(id_col, F.from_json(fenced_json(text_col), RESPONSE).alias("r"))
    e = parsed.select(id_col, F.explode("r.entities").alias("e")).select(id_col, F.trim("e.name").alias("name"), F.lower(F.trim("e.type")).alias("type"))
    e = e.where((F.length("name") > 0) & F.col("type").isin(*types)).distinct()
    r = parsed.select(id_col, F.explode("r.relations").alias("r")).select(id_col, F.trim("r.source").alias("source"), F.lower(F.trim("r.type")).alias("type"), F.trim("r.target").alias("target"))
    return e, r.where("length(source) > 0 and length(type) > 0 and length(target) > 0").distinct()
