"""Every registered query against its SQL twin in DuckDB, on the smallest scale."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract
from harness import registered
from oracle import oracle_queries
from tests.conftest import SMALL

QUERIES = registered.queries()
ORACLE = oracle_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.keys() <= contract.queries().keys()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLE[name])
    columns = [column[0] for column in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = Counter(
        tuple(row[columns.index(name)] for name in df.columns) for row in found.fetchall()
    )
    assert Counter(map(tuple, df.collect())) == expected


def test_entry_is_the_flagship_query(spark):
    assert contract.entry(spark).columns == ["fsn", "ct"]
    assert contract.entry(spark).count() > 0
