"""Joins on keys of which one value may hold a large share of the rows.

Which values do is measured once, when a release is built, and kept as a small table:
there are at most rows / `rows_per_task` of them. A join takes the rows of all other
values as usual, so that a small partner is broadcast; the rows of such values are cut
into slices of about that size, and their partner rows repeated per slice. Without such
values the second part is found empty before it is started.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one value that a task may well handle.
ROWS_PER_TASK = 5_000_000

#: The least share of all rows that `freqItems` looks for.
LEAST_SHARE = 1e-4


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Values of `key` with more rows than that, `(<key>, slices)`.

    Rows are counted by value for those alone that may have so many. `freqItems` misses no value
    above its share, whatever the order of rows, and passes on a few values a task.
    """
    share = rows_per_task / 2 / max(df.count(), 1)
    if share >= 0.5:
        return _hot_of(df.limit(0), key, rows_per_task)
    if share >= LEAST_SHARE:
        # At most two values per `share`.
        frequent = df.stat.freqItems([key], share).first()[0]
        known = [value for value in frequent if value is not None]
        df = df.where(F.col(key).isin(known) | F.col(key).isNull())
    return _hot_of(df, key, rows_per_task)


def _hot_of(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > rows_per_task)
        .select(key, F.ceil(F.col("rows") / rows_per_task).cast("int").alias("slices"))
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    spread: str,
    how: str = "inner",
) -> DataFrame:
    """Join on `keys`, inner or semi, with the rows of hot values spread over slices.

    `hot` comes from `hot_keys` for one of the keys. `spread` is a left column that
    tells rows of one value apart; it decides the slice, so that a task that is run
    again makes the same choice.
    """
    hot_key = next(name for name in hot.columns if name != "slices")
    usual = left.join(hot.select(hot_key), hot_key, "left_anti").join(right, list(keys), how)
    sliced_left = left.join(hot, hot_key).withColumn(
        "_slice", F.pmod(F.xxhash64(spread), "slices").cast("int")
    )
    sliced_right = right.join(hot, hot_key).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    sliced = (
        sliced_left.drop("slices")
        .join(sliced_right.drop("slices"), [*keys, "_slice"], how)
        .drop("_slice")
    )
    return usual.unionByName(sliced)


def repeat_rows(df: DataFrame, times: str, place: str, chunk: int = 10_000) -> DataFrame:
    """Every row as often as its column `times` says, numbered in column `place`.

    Rows are repeated in chunks, as the array behind a large number would not fit.
    """
    chunks = F.floor((F.col(times) - 1) / chunk)
    left = F.col(times) - F.col("_chunk") * chunk
    return (
        df.where(F.col(times) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks)))
        .withColumn(
            place, F.explode(F.sequence(F.lit(1).cast("long"), F.least(left, F.lit(chunk))))
        )
        .withColumn(place, F.col("_chunk") * chunk + F.col(place))
        .drop("_chunk")
    )
