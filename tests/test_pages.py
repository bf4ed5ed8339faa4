"""The SQL for pages against the reader of pages, on articles whose elements are closed or not."""

import random

import duckdb

from lodestone.catalog import pages
from lodestone.functions import html


def test_articles(spark):
    draw = random.Random(5)
    parts = ["<p>", "<p>", "</p>", "<b>", "</b>", "<strong>", "</strong>", "<br>", "<h1>", "</h1>", "some words  \n here", "&amp; more &quot;", " ", "a", "é &copy x", "<!-- a <p> note -->"]
    rows = [(0, f"<html><head><title> A &amp; B </title></head><body><article>{'word ' * 30}</article></body></html>")]
    for i in range(1, 800):
        own = "".join(draw.choices(parts, k=draw.randint(0, 25))).replace("strong>", "b>")
        rows.append((i, f'<html><head><meta name="description" content="D {i}"><title>T{i}</title></head><body><article><h1>Head</h1>{own}{"long text " * 15}</article></body></html>'))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(f"SELECT page_id, title, description, text FROM ({pages.MARKDOWN}) ORDER BY page_id").fetchall()
    got = html.page_texts(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id").collect()
    assert list(map(tuple, got)) == want
