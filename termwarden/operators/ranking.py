"""Numbering rows in order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termwarden.sources.scratch import WorkFolder


def numbered(df: DataFrame, key: str, name: str, start: int, work: WorkFolder) -> DataFrame:
    """`df` with consecutive numbers by its unique `key` in column `name`.

    Rows are stored in ranges of the key. A row's number is its place within its range
    plus the rows of the ranges before it; only the sizes of the ranges, one row each,
    meet in a window without a partition key.
    """
    ranges = work.write(
        f"{name}_ranges",
        df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()),
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return (
        ranges.withColumn("_place", place)
        .join(offsets, "_range")
        .withColumn(name, (F.col("_before") + F.col("_place") + (start - 1)).cast("int"))
        .drop("_range", "_place", "_before")
    )
