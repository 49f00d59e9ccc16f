"""Every query with SQL gives the same table as DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = oracle_sql()[name]
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    picked = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {picked} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry(spark).count() > 0
