"""Ranking, numbering and sequence operators. Every order has an explicit tie-breaker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def numbered(df: DataFrame, by: list[str], order: list, name: str = "chunk_index") -> DataFrame:
    """A running index from 0 within each group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group with their rank; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def recent_documents(meta: DataFrame, n: int = 3, by: str | None = "category") -> DataFrame:
    """The newest n documents of each category, or of all (by=None: a sort with a limit, not one window)."""
    order = [F.desc("start_date"), F.asc("id")]
    return meta.orderBy(*order).limit(n) if by is None else top_per_group(meta, [by], order, n)


def first_per_text(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_first = 1").drop("_first")


def reciprocal_rank(df: DataFrame, by: list[str], score: str, tie: str, k: int = 60) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rrf", 1.0 / (F.row_number().over(w) + k))


def normalised_keyword(df: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """df with norm, the keyword score scaled within each query.

    One row: 1. Two: log1p over the greatest. From three on, rows whose log1p is at or below its 20th percentile get 0 and the
    others are spread between the least and the greatest of them (0.5 if those are equal, so the least one kept has 0).
    Logarithms and percentile count to nine places, so that equal texts, whose sums differ in the last bit, stay equal.
    """
    w = Window.partitionBy(by)
    s = df.withColumn("_s", F.round(F.log1p(score), 9)).withColumn("_n", F.count("*").over(w)).withColumn("_top", F.max("_s").over(w)).withColumn("_q", F.round(F.percentile("_s", F.lit(0.2)).over(w), 9))
    s = s.withColumn("_keep", F.when(F.col("_s") > F.col("_q"), F.col("_s")))
    lo, hi = F.min("_keep").over(w), F.max("_keep").over(w)
    many = F.when(F.col("_keep").isNull(), 0.0).when(lo == hi, 0.5).otherwise((F.col("_keep") - lo) / (hi - lo))
    few = F.when(F.col("_top") > 0, F.col("_s") / F.col("_top")).otherwise(0.0)
    return s.withColumn("norm", F.when(F.col("_n") == 1, 1.0).when(F.col("_n") == 2, few).otherwise(many)).drop("_s", "_n", "_top", "_q", "_keep")


def pseudonym_numbers(matches: DataFrame, doc: str = "doc", kind: str = "type", value: str = "value", start: str = "start") -> DataFrame:
    """matches with number: values of a kind numbered from 1 in the order in which a document first has them."""
    first = matches.withColumn("_f", F.min(start).over(Window.partitionBy(doc, kind, value)))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy(doc, kind).orderBy("_f"))).drop("_f")


def dense_index(df: DataFrame, by: list[str], order: list[str], name: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """df with a running index from 0 within each group, however large: the order is cut into ranges of rows, numbered each
    by itself; a group's rows in earlier ranges, of which there are as many as tasks, are added.

    The ranges are cut from their lineage, so that they are numbered and counted from one sorting.
    """
    parts = max(1, -(-df.count() // rows_per_task))
    ranges = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    at = ranges.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    at = cut(at)
    runs = at.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_from"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    base = runs.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), (before - F.col("_from")).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return at.join(base, same).withColumn(name, F.col("_pos") + F.col("_base")).select(*df.columns, name)


def batch_numbers(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    return dense_index(df, by, order, "_i").withColumn("batch", F.expr(f"_i div {size}")).drop("_i")


def in_blocks(df: DataFrame, by: list[str], order: list[str], size: int, after: int = 0, before: int = 0) -> DataFrame:
    """df with _i, the index in its group, and _block: rows of a group in blocks of `size`, each with copies of so many rows
    after and before it; a row belongs to the block _i div size, in others it is a copy."""
    i = dense_index(df, by, order, "_i").withColumn("_own", F.expr(f"_i div {size}"))
    near = F.array(F.col("_own"), F.when((F.col("_i") % size < after) & (F.col("_own") > 0), F.col("_own") - 1), F.when(F.col("_i") % size >= size - before, F.col("_own") + 1))
    return i.withColumn("_block", F.explode(F.array_compact(near)))


def blank_repeats(rows: DataFrame, by: list[str], order: str, cols: list[str], block: int = 100_000) -> DataFrame:
    """Cells equal to the one above become blank (the look of merged cells). A group's rows are compared in blocks."""
    w = Window.partitionBy(*by, "_block").orderBy("_i")
    dealt = in_blocks(rows, by, [order], block, before=1)
    shown = dealt.withColumns({f"_s_{c}": F.when(F.col(c) == F.lag(c).over(w), "").otherwise(F.col(c)) for c in cols}).where("_block = _own")
    return shown.select(*[F.col(f"_s_{c}").alias(c) if c in cols else F.col(c) for c in rows.columns])


def neighbour_similarity(sentences: DataFrame, by: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """sentences with sim, the cosine of each with the next one of its group (null for the last; 0 beside a vector without length).

    Rows are sorted once and read in batches; a batch's last row waits for the next batch, so that no group is held whole.
    Vectors are of one length.
    """
    names = sentences.columns

    def scored(t: pa.Table) -> pa.RecordBatch:
        x = t.column(vector).combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        n = np.linalg.norm(x, axis=1)
        both = n[1:] * n[:-1]
        sim = np.divide((x[1:] * x[:-1]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0)
        same = np.ones(len(sim), bool)
        for c in by:
            left, right = t.column(c).slice(1), t.column(c).slice(0, len(sim))
            none = pc.and_(pc.is_null(left), pc.is_null(right))
            same &= pc.or_(pc.fill_null(pc.equal(left, right), False), none).to_numpy(zero_copy_only=False)
        out = t.append_column("sim", pa.array(np.r_[sim, 0.0], mask=np.r_[~same, True]))
        return out.combine_chunks().to_batches()[0]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                out = scored(pa.Table.from_batches([*waiting, b]))
                if out.num_rows > 1:
                    yield out.slice(0, out.num_rows - 1)
                waiting = [b.slice(b.num_rows - 1)]
        if waiting:
            yield scored(pa.Table.from_batches(waiting))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema)
    return sentences.repartition(*by).sortWithinPartitions(*by, order).select(*names).mapInArrow(go, f"{schema}, sim double")


def breakpoint_groups(sims: DataFrame, by: list[str], order: str, threshold: float = 0.5) -> DataFrame:
    """sims with group: a new one begins after each row whose similarity to the next is under the threshold.

    Similarities count to six places: those of short sentences often are the threshold itself, which the order of a sum may miss by the last bit.
    """
    cut = F.when(F.round("sim", 6) < threshold, 1).otherwise(0)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sims.withColumn("group", F.coalesce(F.sum(cut).over(w), F.lit(0)))


def header_row(cells: DataFrame, block: int = 100_000) -> DataFrame:
    """(sheet, row, score): the likeliest header row of each sheet; cells (sheet, row, col, value).

    0.4 density + 0.2 share of values that are no number + 0.3 agreement in width with the next three rows + 0.1 for
    standing early; of the five best rows the first one with a score of 0.3 and an agreement of 0.5 at least.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    filled = value != ""
    rows = cells.groupBy("sheet", "row").agg(F.count_if(filled).alias("full"), F.count("*").alias("width"), F.count_if(filled & ~value.rlike("^[0-9.,]+$")).alias("words"))
    nxt = Window.partitionBy("sheet", "_block").orderBy("_i").rowsBetween(1, 3)
    near = in_blocks(rows, ["sheet"], ["row"], block, after=3).withColumn("next", F.avg(F.least("full", F.lit(10**6))).over(nxt)).where("_block = _own").withColumnRenamed("_i", "at")
    agree = F.when(F.col("next").isNull() | (F.greatest("next", "full") == 0), 0.0).otherwise(F.least("next", "full") / F.greatest("next", "full"))
    words = F.when(F.col("full") > 0, F.col("words") / F.col("full")).otherwise(0.0)
    scored = near.withColumn("agreement", agree).withColumn("score", 0.4 * F.col("full") / F.col("width") + 0.2 * words + 0.3 * F.col("agreement") + 0.1 / (F.col("at") + 1))
    best = top_per_group(scored, ["sheet"], [F.desc("score"), F.asc("row")], 5).where("score >= 0.3 and agreement >= 0.5")
    return first_per_text(best, ["sheet"], [F.desc("score"), F.asc("row")]).select("sheet", "row", "score")


def used_width(cells: DataFrame, header_width: int = 0, share: float = 0.05) -> DataFrame:
    """(sheet, width): the last column that at least max(1, share) of the rows use, and the header's width at least."""
    rows = cells.groupBy("sheet").agg(F.count_distinct("row").alias("rows"))
    used = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("sheet", "col").agg(F.count("*").alias("n"))
    ok = used.join(rows, "sheet").where(F.col("n") >= F.greatest(F.lit(1.0), F.col("rows") * share))
    got = ok.groupBy("sheet").agg((F.max("col") + 1).alias("w"))
    return rows.select("sheet").join(got, "sheet", "left").select("sheet", F.greatest(F.coalesce("w", F.lit(0)), F.lit(header_width)).alias("width"))


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a listing, ordered before it is cut."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, after: dict | None = None) -> tuple[DataFrame, Observation]:
    """(page, seen): the `size` rows that follow the row whose order columns are `after` (None: the first page).

    order: columns, and whether they fall; together they name a row. A page is a filter and a limited sort, whose tasks
    keep `size` rows each, however far on it is. seen.get["total"] counts all rows of df in the same reading, once the
    page has been read. Nulls come first where a column rises and last where it falls.
    """
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("total"))
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, falls in order:
            c, v = F.col(name), after[name]
            if v is None:
                next_ = F.lit(False) if falls else c.isNotNull()
            else:
                next_ = (c < F.lit(v)) | c.isNull() if falls else c > F.lit(v)
            beyond, equal = beyond | (equal & F.coalesce(next_, F.lit(False))), equal & c.eqNullSafe(F.lit(v))
        rows = rows.where(beyond)
    return rows.orderBy(*[F.desc(c) if falls else F.asc(c) for c, falls in order]).limit(size), seen


def page_info(total: Column, page: int, size: int) -> list[Column]:
    pages = F.ceil(total / size).cast("bigint")
    return [total.alias("total"), pages.alias("pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_prev")]


def sort_columns(key: str | None, direction: str | None, allowed: tuple[str, ...], default: str, tie: str = "id") -> list[Column]:
    """Sort columns for a whitelisted key; anything else means the default, descending. Ties go by id."""
    key = key if key in allowed else default
    return [F.asc(key) if direction == "asc" else F.desc(key), F.asc(tie)]
