"""Choosing one row per key: loaded duplicates, latest versions, preferred names.

All of them are a ranked window cut at rank one. Spark puts a group limit before the
shuffle of such a window, so each task sends at most one row per key, whatever share
of the rows the key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.sources.scratch import WorkFolder

VERSION_KEY = ("id", "effectiveTime")

#: Column of full rows that says which are the latest version of their component.
LATEST = "_latest"


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every `key` in `order`."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_loaded(
    df: DataFrame, order: Sequence[Column | str], key: Sequence[str] = VERSION_KEY
) -> DataFrame:
    """Enforce a table key: of rows that share it, the one loaded first stays."""
    return first_by(df, key, order)


def marked(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """`first_loaded` with a column `LATEST`, which marks the rows of its `snapshot`.

    Rows are shuffled once, by id, for both. A component has few versions; rows without an id
    may be any number, so they are cut to one per date on the map side first.
    """
    unknown = first_loaded(df.where("id IS NULL"), order)
    return _marked(df.where("id IS NOT NULL"), order).unionByName(_marked(unknown, order))


def _marked(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    versions = Window.partitionBy("id").orderBy(F.desc("effectiveTime"), *order)
    newer = F.lag("effectiveTime").over(versions)
    placed = df.withColumns({LATEST: F.row_number().over(versions) == 1, "_newer": newer})
    return placed.where(
        F.col(LATEST) | ~F.col("effectiveTime").eqNullSafe(F.col("_newer"))
    ).drop("_newer")


def latest(df: DataFrame) -> DataFrame:
    """The snapshot of `marked` rows, in the order of ids where a task has them together."""
    return df.where(LATEST).drop(LATEST).sortWithinPartitions("active", "id")


def snapshot(df: DataFrame) -> DataFrame:
    """Latest version of every component."""
    return first_by(df, ("id",), (F.desc("effectiveTime"),))


def snapshot_naming(
    history: DataFrame, column: str, wanted: DataFrame, work: WorkFolder, name: str
) -> DataFrame:
    """The rows of `snapshot` that name one of `wanted` in `column`; `wanted` is few rows.

    The history is cut to the components of which any version does before it is ranked.
    """
    ids = history.join(wanted, column, "left_semi").select(F.col("id").alias("_id")).distinct()
    asked = work.write(name, ids)
    versions = history.join(asked, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return snapshot(versions).join(wanted, column, "left_semi").select(*history.columns)


def merged(snapshot_before: DataFrame, published: DataFrame) -> DataFrame:
    """The snapshot after `published` versions have been added to the history of another.

    Only components with new versions are ranked. The rest of the snapshot is kept as it
    is, by a join with the published ids, which is a broadcast where those are few.
    """
    ids = published.select("id")
    columns = snapshot_before.columns
    touched = snapshot_before.join(ids, "id", "left_semi").select(*columns)
    kept = snapshot_before.join(ids, "id", "left_anti").select(*columns)
    return kept.unionByName(snapshot(touched.unionByName(published.select(*columns))))


def reranked(history_before: DataFrame, published: DataFrame) -> DataFrame:
    """What `merged` gives, from the histories: for more published rows than are broadcast.

    As there, rows without an id replace none of those loaded before.
    """
    unknown = F.col("id").isNull()
    known = history_before.where(~unknown).unionByName(published)
    return snapshot(history_before.where(unknown)).unionByName(snapshot(known))


def unpublished(history: DataFrame, loaded: DataFrame) -> DataFrame:
    """Of `loaded` rows those whose key the history does not hold yet.

    The history is read at the dates of the loaded rows alone, mostly one.
    """
    dates = [row.effectiveTime for row in loaded.select("effectiveTime").distinct().collect()]
    there = history.where(F.col("effectiveTime").isin(dates)).select(*VERSION_KEY)
    return loaded.join(there, list(VERSION_KEY), "left_anti").select(*loaded.columns)


def extension_changes(
    concepts: DataFrame, release_date: int, extension_module: int
) -> DataFrame:
    """Concepts the extension published at `release_date`, with their version count.

    The published rows lie in one date of the table, one per concept. The history is cut
    to their ids before versions are counted.
    """
    published = concepts.where(
        (F.col("effectiveTime") == release_date) & (F.col("moduleId") == extension_module)
    ).select("id", "active", "definitionStatusId")
    versions = (
        concepts.select("id")
        .join(published.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("versions"))
    )
    return versions.join(published, "id").where("active IS NOT NULL")


def language_terms(descriptions: DataFrame, ctx: CheckContext) -> DataFrame:
    """Active versions of extension-language terms per concept, `(conceptId, terms)`."""
    active = (F.col("active") == 1) & (F.col("languageCode") == ctx.extension_language)
    return descriptions.where(active).groupBy("conceptId").agg(F.count(F.lit(1)).alias("terms"))


def added_counts(before: DataFrame, more: DataFrame, key: str, count: str) -> DataFrame:
    """Counts by key with others added: only the keys of the latter are summed again."""
    touched = before.join(more.select(key), key, "left_semi").select(key, count)
    kept = before.join(more.select(key), key, "left_anti").select(key, count)
    summed = touched.unionByName(more).groupBy(key).agg(F.sum(count).alias(count))
    return kept.unionByName(summed)
