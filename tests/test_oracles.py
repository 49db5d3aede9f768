"""Every query with an oracle, against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
TABLES = ["documents", "pages", "events", "embeddings", "labels", "benchmark", "conversations"]
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return str(value)
    return value


def canonical(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, str(DATA))
    columns = sorted(result.columns)
    cursor = duck.execute(ORACLES[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == columns
    picked = [found.index(c) for c in columns]
    expected = canonical([row[i] for i in picked] for row in cursor.fetchall())
    assert canonical([row[c] for c in columns] for row in result.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
