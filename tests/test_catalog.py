"""Every registered query runs; those with SQL give its rows."""

import math
from decimal import Decimal

import duckdb
import pytest

from lodestone.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return repr(float(v))
    if isinstance(v, (int, float, Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        out = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, out.fetchall())


def test_every_query_reads_a_table(spark, sf_dir):
    for name, f in QUERIES.items():
        plan = f(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation [" in plan or "LogicalRDD" in plan, name
