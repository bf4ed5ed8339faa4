"""Pages to chunks: recursive character splitting, greedy packing of sentences and of table rows, as Arrow jobs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.vectors import embed
from ..operators.windows import breakpoint_groups, in_blocks, neighbour_similarity, numbered
from .text import sentences, slices_of

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, stripped.

    The text is cut before each place of the first separator that it has, which begins the part after it; parts of `size`
    characters or more are cut by the separators that follow. Neighbours that are shorter are joined up to the size, and a
    piece begins with as many whole parts before it as fit into `overlap` characters.
    """
    if overlap >= size:
        raise ValueError("the overlap is not less than the size")
    sep, rest = next(((s, separators[k + 1 :]) for k, s in enumerate(separators) if s == "" or s in text), ("", ()))
    first, *others = text.split(sep) if sep else list(text) or [""]
    parts = [p for p in (first, *(sep + o for o in others)) if p]
    out: list[str] = []
    for short, run in groupby(parts, key=lambda p: len(p) < size or not rest):
        if not short:
            for p in run:
                out += split_text(p, size, overlap, rest)
            continue
        held: deque[str] = deque()
        total = 0
        for p in run:
            if held and total + len(p) > size:
                out.append("".join(held))
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.popleft())
            held.append(p)
            total += len(p)
        out.append("".join(held))
    return [s for x in out if (s := x.strip())]


def _lists(df: DataFrame, text_col: str, name: str, function: Callable[[str], list[str]]) -> DataFrame:
    names = df.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([function(x) if x else [] for x in b.column(text_col).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(go, f"{schema}, `{name}` array<string>")


def fixed_chunks(pages: DataFrame, size: int = 500, overlap: int = 50, by: str = "hash_sha256", text_col: str = "text") -> DataFrame:
    """(by, page_number, chunk_index, text): each page split by itself, chunks numbered over the document."""
    split = _lists(pages.select(by, "page_number", text_col), text_col, "_parts", lambda t: split_text(t, size, overlap))
    rows = split.select(by, "page_number", F.posexplode("_parts").alias("_pos", "text"))
    return numbered(rows, [by], ["page_number", "_pos"]).select(by, "page_number", "chunk_index", "text")


def plain_chunks(docs: DataFrame, size: int = 4_000, by: str = "hash_sha256", text_col: str = "text") -> DataFrame:
    """(by, chunk_index, text): fixed-width slices, in expressions only."""
    return docs.select(by, F.posexplode(slices_of(text_col, size)).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def pack(parts: list[str], most: int) -> list[str]:
    """Parts joined by blanks up to the size; a longer part is cut by width."""
    out, now = [], ""
    for p in parts:
        if now and len(now) + 1 + len(p) > most:
            out.append(now)
            now = ""
        if len(p) > most:
            out += [p[k : k + most] for k in range(0, len(p) - len(p) % most, most)]
            p = p[len(p) - len(p) % most :]
        now = f"{now} {p}" if now and p else now or p
    return [*out, now] if now else out


def semantic_chunks(pages: DataFrame, threshold: float = 0.5, most: int = 1_500, by: str = "hash_sha256", text_col: str = "text", function=None) -> DataFrame:
    """(by, page_number, chunk_index, text): sentences cut where neighbours differ (by a cosine, to six places, under the threshold), groups packed up to the size."""
    rows = pages.select(by, "page_number", F.posexplode(sentences(text_col)).alias("pos", "sentence"))
    vec = embed(rows, "sentence", **({"function": function} if function else {}))
    keys = [by, "page_number"]
    grouped = breakpoint_groups(neighbour_similarity(vec, keys, "pos"), keys, "pos", threshold)
    lists = grouped.groupBy(*keys, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), "\x1f").alias("_t"))
    packed = _lists(lists, "_t", "_parts", lambda t: pack(t.split("\x1f"), most))
    out = packed.select(*keys, "group", F.posexplode("_parts").alias("_pos", "text"))
    return numbered(out, [by], ["page_number", "group", "_pos"]).select(by, "page_number", "chunk_index", "text")


#: The headings of tables in words.
WORDS_HEAD, WORDS_ROW = "## 테이블 데이터", "### 항목 "


def _line_ends(t: pa.Table, head: int, size: int) -> tuple[int, np.ndarray]:
    """How many rows are the block's own, and for each row where the chunk that begins with it ends (exclusive).

    t: rows of one block in order, copies of the next block's first rows last. A chunk has one row at least.
    """
    wide, n = t["_wide"][0].as_py(), t.num_rows
    room = size - len(t["_title"][0].as_py()) - (len(WORDS_HEAD) + 4 if wide else head + 2)
    cost = pc.utf8_length(t["_line"]).to_numpy().astype(np.int64) + (len(WORDS_ROW) + 3 if wide else 1)
    total = np.r_[0, np.cumsum(cost)]
    numbers = np.floor(np.log10(np.arange(1, n + 1) + 0.5)).astype(np.int64) + 1 if wide else np.zeros(n, np.int64)
    digits = np.r_[0, np.cumsum(numbers)]
    start = np.arange(n)
    lo, hi = start + 1, np.full(n, n)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        fits = total[mid] - total[start] + digits[mid - start] <= room
        lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
    return int(pc.sum(pc.equal(t["_own"], t["_block"])).as_py()), lo


def _block_exits(by: str, head: int, size: int):
    """For each row at which a block may be entered: the row of the next block at which it is left, and its chunks; as runs."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        own, to = _line_ends(t, head, size)
        count = np.ones(len(to), np.int64)
        while len(at := np.flatnonzero(to[:own] < own)):
            count[at] += count[to[at]]
            to[at] = to[to[at]]
        most = min(size + 1, own)
        left, count = np.r_[to[:most] - own, 0][: size + 1], np.r_[count[:most], 0][: size + 1]
        lo = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (count[1:] != count[:-1])])
        same = [t[c].take(pa.array(np.zeros(len(lo), np.int64))) for c in (by, "_block")]
        return pa.table([*same, pa.array(lo), pa.array(left[lo]), pa.array(count[lo])], [by, "_block", "_lo", "_left", "_n"])

    return go


def _entries(by: str):
    """For each block of a group the row at which it is entered, and the chunks before."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_block", "ascending"), ("_lo", "ascending")])
        block, lo, left, n = (t[c].to_numpy() for c in ("_block", "_lo", "_left", "_n"))
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        at, before, entry, base = 0, 0, [], []
        for a, e in zip(first, np.r_[first[1:], len(block)], strict=True):
            entry.append(at)
            base.append(before)
            k = a + int(np.searchsorted(lo[a:e], at, side="right")) - 1
            at, before = int(left[k]), before + int(n[k])
        return pa.table([t[by].take(pa.array(first)), pa.array(block[first]), pa.array(entry, pa.int64()), pa.array(base, pa.int64())], [by, "_block", "_entry", "_base"])

    return go


def _block_chunks(by: str, header: str, size: int, schema: pa.Schema):
    def go(t: pa.Table, entries: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        t = t.sort_by("_i")
        own, ends = _line_ends(t, len(header), size)
        lines, wide, title = t["_line"].to_pylist(), t["_wide"][0].as_py(), t["_title"][0].as_py()
        at, k, made = entries["_entry"][0].as_py(), entries["_base"][0].as_py(), []
        while at < own:
            rows = lines[at : ends[at]]
            name = f"{title} (Part {k + 1})" if k else title
            if wide:
                text = f"{name}\n\n{WORDS_HEAD} ({len(rows)}행)\n\n" + "\n".join(f"{WORDS_ROW}{j}\n{x}" for j, x in enumerate(rows, 1))
            else:
                text = f"{name}\n\n{header}" + "\n".join(rows)
            made.append((k, text, len(rows), "structured_text" if wide else "markdown_table"))
            at, k = int(ends[at]), k + 1
        same = t[by].take(pa.array(np.zeros(len(made), np.int64)))
        return pa.table([same, *(pa.array([m[c] for m in made], schema.field(c + 1).type) for c in range(4))], schema.names)

    return go


def table_chunks(rows: DataFrame, headers: list[str], size: int = 1_000, by: str = "sheet", order: str = "row", block: int = 100_000) -> DataFrame:
    """(by, chunk_index, text, row_count, type): rows (by, order, cells array<string>) as markdown tables of at most `size` characters
    (the part's number aside).

    Every chunk repeats title and header, later ones say which part they are; a row that is too long stands alone, and
    where the header alone fills the size rows become lists of their cells. Null cells are blank, missing ones too, further
    ones are left out; a null group has an empty name; rows of equal order go by their text. An empty table has no chunks.

    A group's rows are packed in blocks: each says where it is left for every row at which it may be entered (after a
    few chunks all entries agree, so these are few runs), the runs of a group are followed in turn, and each block then
    writes the chunks that begin in it. The result is that of packing each group from its first row to its last.
    """
    block = max(block, size)
    header = "| " + " | ".join(headers) + " |\n| " + " | ".join("---" for _ in headers) + " |\n"
    title = F.concat(F.lit("# "), F.coalesce(F.col(by).cast("string"), F.lit("")))
    wide = F.length(title) + 2 + len(header) >= size
    cells = [F.regexp_replace(F.coalesce(F.get("cells", F.lit(i)), F.lit("")), r"^\s+|\s+$", "") for i in range(len(headers))]
    one_line = [F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), "\n", " ") for c in cells]
    markdown = F.concat(F.lit("| "), F.array_join(F.array(*one_line), " | "), F.lit(" |"))
    words = F.concat(*[F.when(c != "", F.concat(F.lit(f"- **{h}**: "), c, F.lit("\n"))).otherwise("") for h, c in zip(headers, cells, strict=True)])
    lines = rows.select(by, order, title.alias("_title"), wide.alias("_wide"), F.when(wide, words).otherwise(markdown).alias("_line"))
    dealt = in_blocks(lines, [by], [order, "_line"], block, after=size).select(by, "_block", "_own", "_i", "_title", "_wide", "_line")
    kind = rows.schema[by].dataType
    exits = dealt.groupBy(by, "_block").applyInArrow(_block_exits(by, len(header), size), f"`{by}` {kind.simpleString()}, _block long, _lo long, _left long, _n long")
    entries = exits.groupBy(by).applyInArrow(_entries(by), f"`{by}` {kind.simpleString()}, _block long, _entry long, _base long")
    schema = pa.schema([(by, to_arrow_type(kind)), ("chunk_index", pa.int64()), ("text", pa.string()), ("row_count", pa.int64()), ("type", pa.string())])
    out = f"`{by}` {kind.simpleString()}, chunk_index long, text string, row_count long, type string"
    return dealt.groupBy(by, "_block").cogroup(entries.groupBy(by, "_block")).applyInArrow(_block_chunks(by, header, size, schema), out)


def chart_regions(elements: DataFrame, cell: int = 100, least: int = 5, side: int = 50) -> DataFrame:
    """(doc, page_number, gx, gy, n, x0, y0, x1, y1): grid cells, by the drawings' centres, that are numerous and large enough to be charts.

    Drawings of at most one unit in width or height are lines or dots and do not count.
    """
    gx, gy = F.floor((F.col("x0") + F.col("x1")) / 2 / cell), F.floor((F.col("y0") + F.col("y1")) / 2 / cell)
    drawn = elements.where((F.col("x1") - F.col("x0") > 1) & (F.col("y1") - F.col("y0") > 1))
    box = drawn.groupBy("doc", "page_number", gx.alias("gx"), gy.alias("gy")).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return box.where((F.col("n") >= least) & (F.col("x1") - F.col("x0") > side) & (F.col("y1") - F.col("y0") > side))


def register_splitter(spark, name: str = "split_chunks") -> None:
    """Makes the recursive splitter a table function for SQL: SELECT ... FROM t, LATERAL split_chunks(text, 500, 50)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index: int, chunk: string")
    class SplitChunks:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(split_text(text or "", size, overlap)) if text else ()

    spark.udtf.register(name, SplitChunks)
