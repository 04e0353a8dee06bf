"""Shards by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in a fixed order. A keyed Feistel network permutes the smallest
even-bit domain that holds N, and values beyond N walk the cycle until they fall inside,
so the result is a permutation of 0..N-1 that needs no sort and no table. Position p goes
to shard p mod S and slot p div S: shard sizes differ by one row at most (law `rows`), and
where a row lands can be computed from its number alone.

Rows with a null id are numbered first. Equal ids are ordered by the digest of the text,
equal rows take any of their places. Groups of equal texts are not kept together: that
would break the law. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.llm.common import mixed, numbered, running_sums, with_facts, work_folder
from termwarden.sources.scratch import WorkFolder

ROUNDS = 6


def feistel(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """Where each of the numbers 0..total-1 goes in the keyed permutation."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & mask)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= total)
    while outside.size:
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def sharded(
    docs: DataFrame,
    shards: int,
    key: int = 2024,
    digest: str | None = None,
    work: WorkFolder | None = None,
) -> DataFrame:
    """The rows with `shard` and `slot`; columns of these names are replaced.

    `docs` has `doc_id` and either `text`, whose rows stay where they are read, or a column
    with its digest, which is dropped, and whose rows are sorted themselves.
    """
    work = work or work_folder(docs)
    if digest is None:
        stored = numbered(docs.drop("shard", "slot"), work)
        text = F.coalesce("_doc.text", F.lit(""))
        light = stored.select("_row", "_doc.doc_id", F.sha2(text, 256).alias("_digest"))
        dealt = sharded(light, shards, key, "_digest", work).drop("doc_id")
        return with_facts(stored, dealt, work, "dealt")
    kept = [c for c in docs.columns if c not in ("shard", "slot", digest)]
    rows = docs.select(
        F.struct(*kept).alias("_doc"),
        F.col("doc_id").alias("_id"),
        F.col(digest).alias("_digest"),
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = running_sums(rows, ["_id", "_digest"], ["_one"], work, "ranked")
    total = ranked.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), total, key))

    return ranked.withColumn("_place", place("_one_before")).select(
        "_doc.*",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
    )
