"""Analytics over documents, search results, evaluations and logs: partial and final aggregation, no driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar, finite, seoul_bounds, seoul_date
from ..schemas import STATUSES

HIGH, MEDIUM = 0.825, 0.80
METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")


def daily_cost(meta: DataFrame, start: str, end: str, user_id: int | None = None) -> DataFrame:
    """(date, cost, file_size, documents) for each day of the range, by the Seoul date of end_date; days without rows are 0."""
    rows = meta.where(F.col("end_date").between(seoul_bounds(F.lit(start))[0], seoul_bounds(F.lit(end))[1]))  # on the column itself, for the scan
    rows = rows.where(F.col("user_id") == user_id) if user_id is not None else rows
    got = rows.withColumn("date", seoul_date("end_date")).groupBy("date").agg(
        F.sum(F.coalesce("cost", F.lit(0.0)) + F.coalesce("summary_cost", F.lit(0.0))).alias("cost"), F.sum(F.coalesce("file_size", F.lit(0))).alias("file_size"), F.count("*").alias("documents")
    )
    return calendar(meta.sparkSession, start, end).join(got, "date", "left").select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cost", "file_size", "documents")])


def period_summary(daily: DataFrame) -> DataFrame:
    """Totals of daily rows and means a day: cost as it is, storage as a whole number, documents to two places."""
    t = daily.agg(F.sum("cost").alias("total_cost"), F.sum("file_size").alias("total_size"), F.sum("documents").alias("total_documents"), F.count("*").alias("days"))
    n = F.greatest("days", F.lit(1))
    return t.select("*", (F.col("total_cost") / n).alias("avg_cost"), F.floor(F.col("total_size") / n).alias("avg_size"), F.round(F.col("total_documents") / n, 2).alias("avg_documents"))


def band(score: str = "score") -> Column:
    return F.when(F.col(score) >= HIGH, "high").when(F.col(score) >= MEDIUM, "medium").otherwise("low")


def file_statistics(results: DataFrame, by: str = "query_id", name: str = "filename", score: str = "score") -> DataFrame:
    """(query, file, n, high, medium, low) of search results."""
    b = band(score)
    return results.groupBy(by, name).agg(F.count("*").alias("n"), *[F.count_if(b == x).alias(x) for x in ("high", "medium", "low")])


def search_statistics(results: DataFrame, queries: DataFrame, by: str = "query_id", name: str = "filename", score: str = "score") -> DataFrame:
    """One row a query, zeros for those without results: rows, files, mean, greatest and least score (four places)."""
    got = results.groupBy(by).agg(
        F.count("*").alias("total"), F.count_distinct(name).alias("documents"), F.round(F.avg(score), 4).alias("avg_score"), F.round(F.max(score), 4).alias("max_score"), F.round(F.min(score), 4).alias("min_score")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "documents", "avg_score", "max_score", "min_score")]
    return queries.select(by).distinct().join(got, by, "left").select(by, *zero)


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def category_statistics(meta: DataFrame, categories: DataFrame) -> DataFrame:
    """Documents, bytes and the seven status counts of each category named in categories (name); zeros where it has none."""
    got = meta.groupBy("category").agg(F.count("*").alias("documents"), F.sum("file_size").alias("file_size"), *status_counts())
    cols = [c for c in got.columns if c != "category"]
    return categories.select(F.col("name").alias("category")).join(got, "category", "left").select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def documents_summary(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("file_size"), *status_counts())


def evaluation_means(details: DataFrame, by: str | None = None) -> DataFrame:
    """Means of the metrics over finite values, for all items or by a column (with their number)."""
    aggs = [F.avg(finite(m)).alias(m) for m in METRICS]
    return details.agg(*aggs) if by is None else details.groupBy(by).agg(F.count("*").alias("items"), *aggs)


def reduction(verdicts: DataFrame, tokens_per_chunk: int = 256, price: float = 0.0001) -> DataFrame:
    """Chunks kept and saved: total, selected, saved, rate in percent (two places), tokens and dollars (four places)."""
    t = verdicts.agg(F.count("*").alias("total"), F.count_if("is_relevant").alias("selected")).withColumn("saved", F.col("total") - F.col("selected"))
    tokens = F.col("saved") * tokens_per_chunk
    rate = F.when(F.col("total") > 0, F.round(F.col("saved") / F.col("total") * 100, 2)).otherwise(0.0)
    return t.select("*", rate.alias("rate"), tokens.alias("saved_tokens"), F.round(tokens / 1000 * price, 4).alias("saved_usd"))


def document_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("hash_sha256").agg(F.sum("token").alias("token"), F.sum("cost").alias("cost"), F.count("*").alias("chunks"))


def schedule_counters(history: DataFrame) -> DataFrame:
    """Executions of each schedule: total, successes, failures, last time."""
    ok = F.col("status") == "success"
    return history.groupBy("schedule_id").agg(F.count("*").alias("total_executions"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.max("started_at").alias("last_executed_at"))


def run_outcome(items: DataFrame, by: str = "schedule_id") -> DataFrame:
    """Documents of a run by outcome; one failure makes the run failed."""
    ok = F.count_if("ok")
    return items.groupBy(by).agg(F.count("*").alias("processed"), ok.alias("success"), (F.count("*") - ok).alias("failed"), F.when(ok < F.count("*"), "failed").otherwise("success").alias("status"))


def needs_ocr(pages: DataFrame, by: str = "doc", sample: int = 10) -> DataFrame:
    """Whether a document's first pages hold too little text: pages (doc, page_number, text, n_images).

    Only pages of more than 50 characters count as text pages and add to the length; all sampled pages divide.
    """
    w = Window.partitionBy(by).orderBy("page_number")
    first = pages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    t = first.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(n > 50).alias("full"), F.coalesce(F.sum(F.when(n > 50, n)), F.lit(0)).alias("chars"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("images"))
    avg = F.col("chars") / F.col("pages")
    return t.select(by, ((F.col("full") / F.col("pages") < 0.3) | (avg < 100) | ((F.col("images") / F.col("pages") > 2) & (avg < 200))).alias("needs_ocr"))


def merged_text(pages: DataFrame, by: str = "doc", sep: str = "\n\n") -> DataFrame:
    """(doc, text): the pages' texts in page order, trimmed, blank ones left out. A document's pages meet in one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: F.trim(x["text"]))
    return pages.where(F.length(F.trim("text")) > 0).groupBy(by).agg(F.array_join(parts, sep).alias("text"))


def page_elements(elements: DataFrame) -> DataFrame:
    """(doc, page_number, text): elements of a page joined by line breaks, in their order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("element", "text"))), lambda x: x["text"])
    return elements.groupBy("doc", "page_number").agg(F.array_join(parts, "\n").alias("text"))


def gated_text(fields: DataFrame, least: float = 0.3) -> DataFrame:
    """(doc, text): recognised fields in order, joined by a blank or, after a line's end, a line break; empty under the mean confidence."""
    piece = lambda x: F.concat(x["text"], F.when(x["line_break"], "\n").otherwise(" "))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "text", "line_break"))), piece), ""))
    t = fields.groupBy("doc").agg(F.avg("confidence").alias("c"), joined.alias("t"))
    return t.select("doc", F.when(F.col("c") < least, "").otherwise(F.col("t")).alias("text"))


def activity_score(logs: DataFrame, by: str = "user_id") -> DataFrame:
    """0 to 100 for each user, from requests, success rate, sessions and kinds of action."""
    t = logs.groupBy(by).agg(
        F.count("*").alias("requests"), (F.count_if(F.col("success") == "SUCCESS") * 100.0 / F.count("*")).alias("rate"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("action_type").alias("types")
    )
    score = F.least(F.col("requests") * 2, F.lit(40)) + F.floor(F.col("rate") * 0.3) + F.least(F.col("sessions") * 5, F.lit(20)) + F.least(F.col("types") * 2, F.lit(10))
    return t.select(by, "requests", "sessions", "types", score.cast("bigint").alias("score"))


def delete_preview(df: DataFrame, predicate: Column | str, key: str = "id", most: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many rows a delete would take, and the first of them by key."""
    hit = df.where(predicate)
    return hit.agg(F.count("*").alias("affected")), hit.orderBy(key).limit(most)


def fill_label() -> Column:
    """What became of an item's response: it was there (skipped), it was filled, or that failed."""
    given = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return F.when(given("response"), "skipped").when(given("answer"), "filled").otherwise("failed")


def fill_statistics(items: DataFrame) -> DataFrame:
    """(label, n) of items (id, response, answer)."""
    return items.groupBy(fill_label().alias("label")).agg(F.count("*").alias("n"))


def fill_failures(items: DataFrame) -> DataFrame:
    """(id) of the items that could not be filled, as rows."""
    return items.where(fill_label() == "failed").select("id")


def pii_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("type").agg(F.count("*").alias("n"))


def pii_summary(matches: DataFrame) -> DataFrame:
    """(type, high, medium, low) of exploded matches, zeros filled."""
    return matches.groupBy("type").agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")])


def running_documents(schedules: DataFrame) -> DataFrame:
    """(hash_sha256) of the documents that active schedules name, once each."""
    return schedules.where(F.col("is_active") & F.col("deleted_at").isNull()).select(F.explode("document_hashes").alias("hash_sha256")).distinct()
