"""Every registered query that has SQL, against DuckDB on the smallest tables; and the driver's contract."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from voucherflow.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.date() if isinstance(v, datetime.datetime) else v


def rows(cursor):
    return sorted((tuple(map(plain, r)) for r in cursor), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, SF), oracle.ORACLE_SQL[name]
    rel = duck.sql(sql)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    columns = sorted(df.columns)
    wanted = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(wanted)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.ORACLE_SQL) == set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
