"""Every query with SQL, on the smallest tables, against the comparison engine."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from siltstone.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    cursor = duck.execute(ORACLES[name])
    assert not [d for d in cursor.description if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert found[1] == expected[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
