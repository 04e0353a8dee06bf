from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from termwarden.llm import mixing, oracle, sharding
from tests.llm.conftest import AWKWARD


@pytest.mark.parametrize("total", [1, 2, 3, 16, 17, 1000])
def test_feistel_is_a_permutation(total):
    places = sharding.feistel(np.arange(total), total, 7)
    assert sorted(places.tolist()) == list(range(total))
    if total > 100:
        assert places.tolist() != sharding.feistel(np.arange(total), total, 8).tolist()


def brute_force_shards(rows, shards, key=2024):
    """Row numbers by id and digest, permuted one by one."""
    import hashlib

    order = sorted(
        rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    )
    places = [int(sharding.feistel(np.array([i]), len(order), key)[0]) for i in range(len(order))]
    return sorted(
        (r[0] or -1, p % shards, p // shards) for r, p in zip(order, places, strict=True)
    )


def test_shards_are_even_and_gapless(awkward, docs_of):
    rows = AWKWARD + [(100 + i, f"text {i}") for i in range(200)]
    found = sharding.sharded(docs_of(rows), 7).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in found) == brute_force_shards(rows, 7)


def test_shards_replace_clashing_columns_and_keep_others(docs_of):
    docs = docs_of([(1, "a"), (2, "b")]).withColumns({"shard": F.lit("x"), "_one": F.lit(5), "text_digest": F.lit("x"), "more": F.lit(9)})
    found = sharding.sharded(docs, 2)
    assert set(found.columns) == {*docs.columns, "slot"}
    assert {r.more for r in found.collect()} == {9}
    assert sharding.sharded(docs.limit(0), 2).count() == 0


def run_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for r in rows:
        con.execute("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [r[0], r[1], r[2] if len(r) > 2 else "s"])
    return con.execute(sql).fetchall()


@pytest.mark.parametrize(
    "rows",
    [
        AWKWARD,
        [(i, "w " * (i % 9), f"s{i % 4}" if i % 7 else None) for i in range(300)],
        [(i, "w " * (1 if i else 3000), "big" if i % 3 else "small") for i in range(100)],
        [(1, "only", "one")],
        [(1, None, "one"), (2, " ", "two")],
        [],
    ],
)
def test_mix_meets_its_targets(docs_of, rows):
    found = [tuple(r) for r in mixing.taken_words(docs_of(rows)).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(found, key=key) == sorted(run_sql(rows, oracle.OP6), key=key)
    total = sum(r[1] for r in found)
    assert sum(r[4] for r in found) == pytest.approx(1.5 * total, abs=8)
    assert all(r[4] <= 2 * r[1] for r in found)


def test_a_source_of_its_own_may_hold_all_rows(docs_of):
    rows = [(i, "w " * 5, "hot" if i % 3 else f"s{i}") for i in range(600)]
    found = mixing.taken_words(docs_of(rows)).groupBy("source_size", "target").agg(F.sum("taken").alias("t"))
    assert all(abs(r.t - r.target * (1 if r.source_size > 5 else 0) ) <= 1 for r in found.collect() if r.source_size > 5)


def test_mixed_documents_are_whole_rows(docs_of):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(90)]
    docs = docs_of(rows).withColumns({"size": F.lit("clash"), "copies": F.lit(1), "cut": F.lit(2)})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2
    assert abs(sum(copies.values()) - 135) <= 3
    assert {r["size"] for r in mixed.collect()} == {"clash"}
