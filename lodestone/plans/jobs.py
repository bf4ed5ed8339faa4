"""Document jobs: registration, embedding, rollback, edits, deletes, retention. Each maps tables to new tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import fixed_chunks
from ..functions.predicates import has_role, stale
from ..functions.scalars import chunk_settings, embedding_cost, entity_text, n_words, next_time, suffix
from ..operators import joins, keyword
from ..operators.vectors import embed, hashed_embedding, zero_vector
from ..sources.tables import cut, delete_keys, exists, patch, remove, row_key, upsert, write_counted

DIM = 1_536
#: What a document's row is set back to; a vector becomes a zero vector.
META_RESET = {
    "status": "registered", "summary": "", "summary_token": 0, "summary_cost": 0.0, "chunk_count": 0, "token": 0, "cost": 0.0, "embedding_start_date": 0, "embedding_end_date": 0,
    "original_chunk_count": 0, "filtered_chunk_count": 0, "chunk_size": 0, "chunk_overlap": 0, "anonymization_strategy": "", "enable_pii_anonymization": 0, "pii_types": "", "embedding_value": "zero",
}
_COUNTERS = ("token", "cost", "chunk_count", "chunk_size", "chunk_overlap", "enable_pii_anonymization", "pii_types", "original_chunk_count", "filtered_chunk_count", "embedding_start_date", "embedding_end_date")


def _given(df: DataFrame, name: str, kind: str, default=None) -> Column:
    got = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def _settings(df: DataFrame) -> tuple[Column, Column]:
    """Chunk size and overlap of rows that may have chunking, chunk_size, chunk_overlap, max_chunk_size."""
    s = chunk_settings(_given(df, "chunking", "string", "fixed"), _given(df, "chunk_size", "bigint"), _given(df, "chunk_overlap", "bigint"), _given(df, "max_chunk_size", "bigint"))
    return s["chunk_size"].cast("bigint"), s["chunk_overlap"].cast("bigint")


def register(files: DataFrame, meta: DataFrame, now: int, dim: int = DIM) -> DataFrame:
    """New rows of meta for files whose content their group has not: every column of a document's row.

    files: (id, group_id, user_id, filename, category, file_size, hash_sha256, role_ids, expiration_date) and, where they
    have them, title, file_type, file_path, download_url, persona_id, start_date, the settings of chunking and of
    personal data. The row is registered, its counters zero, its vector a zero vector.
    """
    new = joins.not_registered(files, meta)
    size, overlap = _settings(new)
    private = _given(new, "enable_pii_anonymization", "boolean", False)
    types = F.array_join(_given(new, "pii_types", "array<string>"), ",")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("chunk_count", "token", "summary_token", "original_chunk_count", "filtered_chunk_count", "embedding_start_date", "embedding_end_date")]
    return new.select(
        "id", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce(_given(new, "title", "string"), F.regexp_replace("filename", r"(?<=.)\.[^.]*$", "")).alias("title"), "filename",
        F.lit("").alias("summary"), F.coalesce(_given(new, "file_type", "string"), suffix("filename")).alias("file_type"), "file_size", F.lit("registered").alias("status"), "role_ids",
        _given(new, "persona_id", "bigint", 0).alias("persona_id"), _given(new, "file_path", "string").alias("file_path"), _given(new, "download_url", "string").alias("download_url"), *zero,
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("summary_cost"), "group_id", "user_id", "hash_sha256", _given(new, "start_date", "bigint", now).alias("start_date"), F.lit(now).cast("bigint").alias("end_date"),
        "expiration_date", zero_vector(dim).alias("embedding_value"), F.when(private, _given(new, "pii_strategy", "string")).alias("anonymization_strategy"), size.alias("chunk_size"),
        overlap.alias("chunk_overlap"), private.cast("bigint").alias("enable_pii_anonymization"), F.when(private & (types != ""), types).alias("pii_types"),
    )


def make_chunks(meta: DataFrame, pages: DataFrame, run_id: str, size: int = 500, overlap: int = 50, function: Callable = hashed_embedding, verdicts: DataFrame | None = None) -> DataFrame:
    """Chunk rows of registered documents: split, filtered by verdicts (hash_sha256, chunk_index, is_relevant, relevance), embedded, priced."""
    ready = meta.where("status = 'registered'").select("hash_sha256", "group_id", "role_ids", "category", "title", "filename")
    parts = fixed_chunks(pages.join(ready.select("hash_sha256"), "hash_sha256", "left_semi"), size, overlap).withColumnRenamed("text", "parsed_text")
    if verdicts is not None:
        parts = joins.with_verdicts(parts, verdicts, ["hash_sha256", "chunk_index"]).where("is_relevant").drop("is_relevant", "relevance")
    vec = embed(parts, "parsed_text", function)
    tokens = F.floor(n_words("parsed_text") / 2)
    out = vec.withColumn("token", tokens.cast("bigint")).withColumn("cost", embedding_cost(F.col("token"))).join(ready, "hash_sha256")
    return out.select(row_key("hash_sha256", "chunk_index").alias("chunk_id"), F.lit(run_id).alias("run_id"), "*")


def index_postings(chunks: DataFrame) -> DataFrame:
    """(doc_key, hash_sha256, chunk_index, term, tf): the keyword rows of chunks."""
    split = chunks.select(keyword.chunk_key().alias("doc_key"), "hash_sha256", "chunk_index", keyword.terms("parsed_text").alias("_t"))
    return keyword.as_postings(keyword.counted(split, "_t"))


def write_run(chunks: DataFrame, path: str, run_id: str) -> tuple[int, int]:
    """(chunks, postings) of a run, written to both stores of a folder or to neither.

    The chunks are made once, in the shared folder; each store's write is counted and held against what was made. A write
    that fails, or that counts otherwise, takes back what the run has written. A run that is there already is left as it
    is, so that a run may be given twice.
    """
    spark = chunks.sparkSession
    done = f"{path}/runs/run_id={run_id}"
    if exists(spark, done):
        row = spark.read.parquet(done).first()
        return row.chunks, row.postings
    made = cut(chunks.drop("run_id"))
    posted = cut(index_postings(made))
    sizes = made.count(), posted.count()
    try:
        for name, rows, n in (("chunks", made, sizes[0]), ("postings", posted, sizes[1])):
            write_counted(rows, f"{path}/{name}/run_id={run_id}", n, mode="overwrite")
        spark.createDataFrame([sizes], "chunks long, postings long").coalesce(1).write.mode("overwrite").parquet(done)
    except Exception:
        for name in ("chunks", "postings", "runs"):
            remove(spark, f"{path}/{name}/run_id={run_id}")
        raise
    return sizes


def embedding_run(meta: DataFrame, pages: DataFrame, path: str, run_id: str, now: int, size: int = 500, overlap: int = 50, function: Callable = hashed_embedding, verdicts: DataFrame | None = None) -> DataFrame:
    """meta after one run over its registered documents: running, then their chunks and keyword rows in both stores, then the final counters.

    pages (hash_sha256, page_number, text). Documents of the run are uploaded with the numbers of their chunks, tokens and costs;
    those without a chunk are skipped. If a store cannot be written the run's documents are failed, and neither store has rows of it.
    """
    mine = cut(meta.where("status = 'registered'").select("hash_sha256").distinct())
    running = final_status(meta, mine.withColumn("status", F.lit("running")), now)
    fields = ("group_id", "role_ids", "category", "title", "filename", "status")
    ready = meta.where("status = 'registered'").groupBy("hash_sha256").agg(F.min_by(F.struct(*fields), "id").alias("r")).select("hash_sha256", "r.*")
    chunks = make_chunks(ready, pages, run_id, size, overlap, function, verdicts)
    try:
        write_run(chunks, path, run_id)
    except Exception:
        return final_status(running, mine.withColumn("status", F.lit("failed")), now)
    written = meta.sparkSession.read.parquet(f"{path}/chunks/run_id={run_id}")
    totals = written.groupBy("hash_sha256").agg(F.count("*").alias("chunk_count"), F.sum("token").alias("token"), F.sum("cost").alias("cost"))
    out = mine.join(totals, "hash_sha256", "left").withColumn("status", F.when(F.col("chunk_count").isNull(), "skipped").otherwise("uploaded"))
    out = out.withColumns({"original_chunk_count": F.col("chunk_count"), "filtered_chunk_count": F.col("chunk_count"), "chunk_size": F.lit(size), "chunk_overlap": F.lit(overlap), "embedding_start_date": F.lit(now), "embedding_end_date": F.lit(now)})
    return final_status(running, out, now)


def final_status(meta: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """meta after a run: outcomes (hash_sha256, status and what the run counted and used) sets the status.

    Documents that are uploaded or skipped also take the run's counters and settings (0 or null where it has none), the
    end date, and its persona where that is not 0; of others only the status changes.
    """
    size, overlap = _settings(outcomes)
    values: dict[str, Column] = {c: _given(outcomes, c, meta.schema[c].dataType.simpleString(), None if c == "pii_types" else 0) for c in _COUNTERS if c in meta.columns}
    values |= {c: v for c, v in (("chunk_size", size), ("chunk_overlap", overlap), ("end_date", F.lit(now).cast("bigint"))) if c in meta.columns}
    done = F.col("_status").isin("uploaded", "skipped")
    new = outcomes.select("hash_sha256", F.col("status").alias("_status"), _given(outcomes, "persona_id", "bigint", 0).alias("_persona"), *[v.alias(f"_new_{c}") for c, v in values.items()])
    both = meta.join(new, "hash_sha256", "left")
    changed = {c: F.when(done, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values} | {"status": F.coalesce("_status", "status")}
    if "persona_id" in meta.columns:
        changed["persona_id"] = F.when(done & (F.col("_persona") != 0), F.col("_persona")).otherwise(F.col("persona_id"))
    return both.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in meta.columns])


def roll_back(meta: DataFrame, chunks: DataFrame, postings: DataFrame, requested: DataFrame, roles: Iterable[int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(meta, chunks, postings, verdicts): chunk and keyword rows of the valid documents gone, their meta rows reset."""
    verdicts = joins.validate(requested, meta.where(has_role(roles)), _rollback_statuses())
    good = verdicts.where("reason is null").select("hash_sha256")
    hit = good.withColumn("_hit", F.lit(True))
    marked = meta.join(hit, "hash_sha256", "left")
    blank = {c: F.transform(c, lambda x: F.lit(0).cast("float")) if v == "zero" else F.lit(v).cast(meta.schema[c].dataType) for c, v in META_RESET.items() if c in meta.columns}
    reset = {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in blank.items()}
    return marked.withColumns(reset).select(*meta.columns), delete_keys(chunks, good), delete_keys(postings, good), verdicts


def _rollback_statuses() -> tuple[str, ...]:
    from ..schemas import ROLLBACK_STATUSES

    return ROLLBACK_STATUSES


def undo_run(chunks: DataFrame, postings: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Both stores without one run's rows."""
    gone = chunks.where(F.col("run_id") == run_id).select("hash_sha256", "chunk_index")
    return chunks.where(~(F.col("run_id") == run_id)), postings.join(gone, ["hash_sha256", "chunk_index"], "left_anti")


def delete_documents(meta: DataFrame, chunks: DataFrame, postings: DataFrame, requested: DataFrame, roles: Iterable[int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(meta, chunks, postings, unauthorised): the authorised documents deleted from all three."""
    yes, no = joins.split_authorised(requested, meta, roles)
    return delete_keys(meta, yes), delete_keys(chunks, yes), delete_keys(postings, yes), no


def edit_chunks(chunks: DataFrame, edits: DataFrame, function: Callable = hashed_embedding) -> DataFrame:
    """chunks with new texts (chunk_id, parsed_text): vectors, tokens and costs of the changed rows are made again."""
    changed = chunks.drop("parsed_text", "embedding", "token", "cost").join(edits.select("chunk_id", "parsed_text"), "chunk_id")
    new = embed(changed, "parsed_text", function).withColumn("token", F.floor(n_words("parsed_text") / 2).cast("bigint")).withColumn("cost", embedding_cost(F.col("token")))
    return upsert(chunks, new.select(*chunks.columns), ["chunk_id"])


def edit_chunks_indexed(chunks: DataFrame, postings: DataFrame, edits: DataFrame, function: Callable = hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings) after edits (chunk_id, parsed_text): what index_postings gives for the new chunks, of which only the changed ones are split again."""
    moved = chunks.join(edits.select("chunk_id", F.col("parsed_text").alias("_new")), "chunk_id").select("hash_sha256", "chunk_index", F.col("_new").alias("parsed_text"))
    kept = delete_keys(postings, moved.select("hash_sha256", "chunk_index"))
    return edit_chunks(chunks, edits, function), kept.unionByName(index_postings(moved))


def edit_meta(meta: DataFrame, edits: DataFrame, text_cols: tuple[str, ...] = ("summary",), key: str = "id", function: Callable = hashed_embedding) -> DataFrame:
    """meta with changed columns; the vector is made again only where one of text_cols changes."""
    cols = [c for c in edits.columns if c != key]
    both = meta.join(edits.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols]), key, "left")
    moved = F.lit(False)
    for c in text_cols:
        if c in cols:
            moved = moved | (F.col(f"_n_{c}").isNotNull() & ~F.col(f"_n_{c}").eqNullSafe(F.col(c)))
    both = both.withColumn("_moved", moved).withColumns({c: F.coalesce(f"_n_{c}", c) for c in cols if c in meta.columns}).drop(*[f"_n_{c}" for c in cols])
    fresh = embed(both.where("_moved").drop("embedding").withColumn("_t", F.concat_ws(". ", *text_cols)), "_t", function)
    return both.where("not _moved").select(*meta.columns).unionByName(fresh.select(*meta.columns))


def set_status(meta: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    from ..schemas import STATUSES

    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return patch(meta, keys.select("hash_sha256").distinct().withColumn("status", F.lit(status)), ["hash_sha256"])


def status_change_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, same): a status change adds and loses no row."""
    a, b = before.agg(F.count("*").alias("before")), after.agg(F.count("*").alias("after"))
    return a.crossJoin(b).withColumn("same", F.col("before") == F.col("after"))


def soft_delete(rows: DataFrame, requested: DataFrame, user_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts): deleted_at set for the user's own, not yet deleted rows; verdicts say deleted or failed for each id."""
    own = rows.where((F.col("user_id") == user_id) & F.col("deleted_at").isNull()).select("id")
    ids = requested.select("id").distinct()
    verdicts = ids.join(own.withColumn("_ok", F.lit(True)), "id", "left").select("id", F.when(F.col("_ok"), "deleted").otherwise("failed").alias("outcome"))
    good = verdicts.where("outcome = 'deleted'").select("id")
    return patch(rows, good.withColumn("deleted_at", F.lit(now).cast(rows.schema["deleted_at"].dataType)), ["id"]), verdicts


def get_or_create(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """table with the wanted rows whose key it lacks (one of those that repeat, the least)."""
    w = Window.partitionBy(key).orderBy(*[c for c in wanted.columns if c != key] or [key])
    one = wanted.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return table.unionByName(one.join(table.select(key), key, "left_anti"), allowMissingColumns=True)


def edit_relations(table: DataFrame, edits: DataFrame, function: Callable = hashed_embedding) -> DataFrame:
    """Relation types (id, relation_type, description, synonyms array<string>, embedding, ...) with edited columns.

    Only rows in which the description or the synonyms change get a new vector, of kind, description and synonyms.
    """
    cols = [c for c in edits.columns if c != "id"]
    both = table.join(edits.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols]), "id", "left")
    moved = [~F.col(f"_n_{c}").eqNullSafe(F.col(c)) for c in ("description", "synonyms") if c in cols]
    again = F.coalesce(F.col("_hit"), F.lit(False)) & (moved[0] | moved[-1] if moved else F.lit(False))
    new = both.withColumn("_again", again).withColumns({c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols}).select(*table.columns, "_again")
    fresh = embed(new.where("_again").drop("embedding").withColumn("_t", entity_text("relation_type", "description", "synonyms")), "_t", function)
    return new.where("not _again").select(*table.columns).unionByName(fresh.select(*table.columns))


def guarded(requested: DataFrame, violations: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused with reason): keys that a table of violations names are refused; the first reason by name counts."""
    bad = None
    for reason, keys in sorted(violations.items()):
        one = keys.select(key).distinct().withColumn("reason", F.lit(reason))
        bad = one if bad is None else bad.union(one)
    bad = bad.groupBy(key).agg(F.min("reason").alias("reason"))
    return requested.join(bad, key, "left_anti"), requested.join(bad, key)


def ready_for_embedding(requested: DataFrame, meta: DataFrame) -> DataFrame:
    """Requested hashes with six fields of their registered row, or the reason why there is none."""
    verdicts = joins.validate(requested, meta, ("registered",))
    own = meta.where("status = 'registered'").groupBy("hash_sha256").agg(F.min(F.struct("id", "group_id", "user_id", "category", "title", "filename")).alias("r"))
    return verdicts.join(own, "hash_sha256", "left").select("hash_sha256", "reason", "r.*")


def reap(jobs: DataFrame, pending_before: int, running_before: int, now: int) -> DataFrame:
    """Stale jobs failed, with a message and a completion time."""
    old = F.coalesce(stale(pending_before, running_before), F.lit(False))
    message = F.when(F.col("status") == "pending", "not started in time").otherwise("not completed in time")
    kind = jobs.schema["completed_at"].dataType
    return jobs.select(*[
        F.when(old, F.lit("failed")).otherwise(F.col("status")).alias(c) if c == "status" else F.when(old, message).otherwise(F.col(c)).alias(c) if c == "error_message"
        else F.when(old, F.lit(now).cast(kind)).otherwise(F.col(c)).alias(c) if c == "completed_at" else F.col(c) for c in jobs.columns
    ])


def retain(rows: DataFrame, now, days: int = 90, col: str = "created_at", least: int = 7) -> tuple[DataFrame, DataFrame]:
    """(kept rows, count of those that are older than the days)."""
    if days < least:
        raise ValueError(f"at least {least} days are kept")
    cutoff = F.lit(now) - F.expr(f"interval {int(days)} days")
    old = F.col(col) < cutoff
    return rows.where(~F.coalesce(old, F.lit(False))), rows.where(old).agg(F.count("*").alias("deleted"))


def due_work(schedules: DataFrame, meta: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(work, history): documents of due schedules, and a row for each with how many are ready."""
    from ..functions.predicates import due

    rows = schedules.where(due(now)).select(F.col("id").alias("schedule_id"), F.explode(F.array_distinct("document_hashes")).alias("hash_sha256"))
    ready = meta.where("status = 'registered'").select("hash_sha256").distinct().withColumn("ok", F.lit(True))
    work = rows.join(ready, "hash_sha256", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    from ..operators.aggregates import run_outcome

    return work.where("ok").select("schedule_id", "hash_sha256"), run_outcome(work)


def advance(schedules: DataFrame, now: int) -> DataFrame:
    """schedules after a tick: those due without a cron_expression are switched off, the others have their next time.

    A cron_expression that is not of five fields, or that names no day, leaves its schedule as it is.
    """
    from ..functions.predicates import due

    hit = F.coalesce(due(now), F.lit(False))
    once = F.coalesce(F.trim("cron_expression"), F.lit("")) == ""
    changed = {
        "is_active": F.when(hit & once, F.lit(False)).otherwise(F.col("is_active")),
        "scheduled_at": F.when(hit & ~once, F.coalesce(next_time("cron_expression", now), F.col("scheduled_at"))).otherwise(F.col("scheduled_at")),
    }
    return schedules.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in schedules.columns])
