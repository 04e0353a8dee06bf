"""Fully specified names, semantic tags and display terms of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.functions.text import semantic_tag
from termwarden.operators.versions import first_by
from termwarden.sources.scratch import WorkFolder


def fully_specified_names(descriptions_snap: DataFrame, ctx: CheckContext) -> DataFrame:
    """One active name per concept `(conceptId, fsn)`.

    Releases exist in which a concept has several; base-language names go first, then
    newer ones, then lower ids. `ambiguous_names` lists such concepts.
    """
    names = _active_names(descriptions_snap, ctx).withColumn(
        "_foreign", F.col("languageCode") != ctx.base_language
    )
    order = ("_foreign", F.desc("effectiveTime"), "id")
    return first_by(names, ("conceptId",), order).select(
        "conceptId", F.col("term").alias("fsn")
    )


def ambiguous_names(descriptions_snap: DataFrame, ctx: CheckContext) -> DataFrame:
    """Concepts with more than one active fully specified name, with their number."""
    return (
        _active_names(descriptions_snap, ctx)
        .groupBy("conceptId")
        .agg(F.count(F.lit(1)).alias("names"))
        .where("names > 1")
    )


def with_names(
    concepts_snap: DataFrame, descriptions_snap: DataFrame, ctx: CheckContext
) -> DataFrame:
    """Snapshot concepts that have a name, with `fsn` and `semtag` added."""
    names = fully_specified_names(descriptions_snap, ctx)
    return (
        concepts_snap.join(names, concepts_snap["id"] == names["conceptId"])
        .drop("conceptId")
        .withColumn("semtag", semantic_tag(F.col("fsn")))
    )


def renamed(
    named_before: DataFrame,
    concepts_snap: DataFrame,
    descriptions_snap: DataFrame,
    descriptions_before: DataFrame,
    published_concepts: DataFrame,
    published_descriptions: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """`with_names` of the new snapshots, from that of the old ones.

    Only concepts that have new versions, or that a description with new versions names or
    named, are looked up again.
    """
    moved = descriptions_before.join(published_descriptions.select("id"), "id", "left_semi")
    asked = work.write(
        "asked",
        published_concepts.select("id")
        .unionByName(published_descriptions.select(F.col("conceptId").alias("id")))
        .unionByName(moved.select(F.col("conceptId").alias("id")))
        .distinct(),
    )
    of_them = asked.select(F.col("id").alias("conceptId"))
    columns = named_before.columns
    again = with_names(
        concepts_snap.join(asked, "id", "left_semi").select(*concepts_snap.columns),
        descriptions_snap.join(of_them, "conceptId", "left_semi").select(*descriptions_snap.columns),
        ctx,
    )
    kept = named_before.join(asked, "id", "left_anti").select(*columns)
    return kept.unionByName(again.select(*columns))


def with_package_names(
    concepts: DataFrame, descriptions: DataFrame, ctx: CheckContext
) -> DataFrame:
    """Concepts of a snapshot package: all stay, and only active ones get a tag.

    A concept without a name has the empty one, as the table's NOT NULL column does.
    """
    names = fully_specified_names(descriptions, ctx)
    return (
        concepts.join(names, concepts["id"] == names["conceptId"], "left")
        .drop("conceptId")
        .withColumn("fsn", F.coalesce("fsn", F.lit("")))
        .withColumn("semtag", F.when(F.col("active") == 1, semantic_tag(F.col("fsn"))))
    )


def preferred_terms(
    descriptions_snap: DataFrame,
    languagerefsets_snap: DataFrame,
    ctx: CheckContext,
    active_members_only: bool,
) -> DataFrame:
    """Active extension-language terms marked as preferred: `(conceptId, id, term, marks)`.

    `marks` is the number of language-refset rows that mark the term; they are counted
    before the join, as one description may have any number of them. Members are cut to
    the terms before that: where those are few, the refset is not shuffled.
    """
    terms = descriptions_snap.where(
        (F.col("active") == 1) & (F.col("languageCode") == ctx.extension_language)
    ).select("conceptId", "id", "term")
    members = languagerefsets_snap.where(F.col("acceptabilityId") == ctx.preferred)
    if active_members_only:
        members = members.where(F.col("active") == 1)
    marks = (
        members.select(F.col("referencedComponentId").alias("id"))
        .join(terms.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("marks"))
    )
    return terms.join(marks, "id").select("conceptId", "id", "term", "marks")


def _active_names(descriptions_snap: DataFrame, ctx: CheckContext) -> DataFrame:
    return descriptions_snap.where(
        (F.col("active") == 1) & (F.col("typeId") == ctx.fully_specified_name)
    )
