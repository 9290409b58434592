"""Every registered query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(FOLDER).glob("*.parquet")]


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, database, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = database.sql(__spark_entry__.oracle_sql()[name])
    at = [relation.columns.index(c) for c in sorted(relation.columns)]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert columns == sorted(relation.columns)
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
