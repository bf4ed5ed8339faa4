"""The SQL of the splitters against the splitters themselves, on texts of every mixture of separators."""

import random

import duckdb
import pytest

from lodestone.catalog import splitting
from lodestone.functions.chunking import pack, split_text


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    word = lambda: draw.choice(["a", "bb", "ccc", "dddd" * 3, "é각", "x" * draw.randint(1, 70), " "])
    gap = lambda: draw.choice([" ", " ", " ", "\n", "\n\n", "  ", "\n\n\n", ""])
    made = ["".join(word() + gap() for _ in range(draw.randint(0, 60))) for _ in range(400)]
    return [*made, "", "x" * 100, "\n\n", "x y", "x" * 50 + "\n\n" + "y" * 29 + "\n\n"]


@pytest.mark.parametrize("size,overlap", [(30, 10), (30, 0), (50, 49), (7, 3)])
def test_recursive(texts, size, overlap):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (key BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    sql = f"WITH RECURSIVE {splitting.pieces('SELECT key, text FROM t', size, overlap)} SELECT key, text FROM pieces ORDER BY key, path, k"
    want = [(k, p) for k, t in enumerate(texts) if t for p in split_text(t, size, overlap)]
    assert con.execute(sql).fetchall() == want


@pytest.mark.parametrize("most", [1, 5, 30])
def test_packed(texts, most):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (key BIGINT, i BIGINT, part VARCHAR)")
    groups = [(k, [p for p in t.split(" ") if p]) for k, t in enumerate(texts)]
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, i, p) for k, parts in groups for i, p in enumerate(parts)])
    sql = f"WITH RECURSIVE {splitting.packed('SELECT key, i, part FROM t', most)} SELECT key, text FROM packs ORDER BY key, k"
    assert con.execute(sql).fetchall() == [(k, x) for k, parts in groups for x in pack(parts, most)]
