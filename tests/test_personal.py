"""The SQL for personal data against the operators, on texts in which every kind occurs and kinds overlap."""

import random

import duckdb
import pytest

from lodestone.catalog import personal
from lodestone.functions import pii
from lodestone.operators import windows as W

VALUES = [
    "900101-1234567", "9001011234567", "050505 3234567", "500101-2000000", "900101-5234567", "M12345678", "AB1234567", "12-34-567890-12", "010-1234-5678", "01012345678",
    "0101234567", "010 123 4567", "016-123 4567", "013-1234-5678", "010-12345678", "02-123-4567", "031 1234 5678", "1234-5678-9012-3456", "4111111111111111", "3111 1111-11111111",
    "9111 1111 1111 1111", "7111-1111-1111-1111", "123456", "1234567890", "12345678901234", "123-45-67890", "user@domain.com", "a@b.c.de", "x.y+z@ab-c.org", "192.168.0.1", "1.22.333.4444",
    "aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "aa:bb-cc:dd-ee:ff", "01234", "31234", "71234", "91234", "12345", "é", "각", " ", "　", ".", "-", " ", "\n", "x", "@", ":", "1", "010",
]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(3)
    texts = [*VALUES, None, "", " ".join(VALUES), "".join(VALUES)]
    texts += [draw.choice([" ", "", "\n", "-", " "]).join(draw.choices(VALUES, k=draw.randint(1, 14))) for _ in range(1500)]
    rows = [(i, t, draw.choice(["en", "fr", "de", "es", None])) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8).cache(), con


def _same(df, con, sql):
    names = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_log_and_numbers(tables):
    docs, con = tables
    log = pii.match_rows(pii.anonymized(docs), "doc_id")
    assert {r.type for r in log.select("type").distinct().collect()} == set(pii.KINDS)
    _same(log, con, personal.LOG)
    _same(W.pseudonym_numbers(log, doc="doc_id").select("doc_id", "type", "start", "number"), con, personal.NUMBERS)


@pytest.mark.parametrize("strategy,sql", [("mask", personal.MASKED), ("pseudonymize", personal.PSEUDONYMS)])
def test_texts(tables, strategy, sql):
    docs, con = tables
    _same(pii.anonymized(docs, strategy=strategy).select("doc_id", "clean_text"), con, sql)


def test_strategies_by_language(tables, spark):
    docs, con = tables
    own = {"en": ("generalize", pii.KINDS), "fr": ("none", ()), "de": ("risk", ("email", "phone", "postal_code", "account"))}
    config = spark.createDataFrame([(k, s, list(kinds)) for k, (s, kinds) in own.items()], "file_type string, strategy string, kinds array<string>")
    src = pii.with_strategy(docs.withColumnRenamed("lang", "file_type"), config)
    _same(pii.anonymized(src, strategy_col="strategy", kinds_col="kinds").select("doc_id", "clean_text"), con, personal.by_strategy(own, ("mask", pii.ENABLED)))
