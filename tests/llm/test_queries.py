from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from termwarden.llm import oracle, queries
from tests.conftest import SMALL

DOCUMENTS = {"doc_id"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_and_agree_with_sql(spark, name):
    found = queries.queries()[name](spark, SMALL)
    assert len(set(found.columns)) == len(found.columns)
    rows = found.toPandas()
    assert len(rows)
    if "language_model" in name:
        held_out = rows[rows.held_out]
        assert held_out.score.sum() > held_out.base_score.sum()
    if sql := oracle.oracle_queries().get(name):
        con = duckdb.connect()
        for table in ("documents", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS FROM '{SMALL}/{table}.parquet'")
        expected = con.execute(sql).df()
        columns = sorted(rows.columns)
        assert columns == sorted(expected.columns)
        by = [next(c for c in ("doc_id", "conv_id", "vec_id") if c in columns)]
        pd.testing.assert_frame_equal(
            rows[columns].sort_values(by, ignore_index=True),
            expected[columns].sort_values(by, ignore_index=True),
            check_dtype=False,
        )
