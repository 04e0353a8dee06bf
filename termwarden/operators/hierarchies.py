"""The top hierarchies: the root concept and its children, named and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.operators.names import preferred_terms
from termwarden.operators.ranking import numbered
from termwarden.operators.versions import snapshot_naming
from termwarden.sources.scratch import WorkFolder


def top_concepts(
    spark: SparkSession, relationships_snap: DataFrame, ctx: CheckContext, work: WorkFolder
) -> DataFrame:
    """`(conceptId, displayOrder)`: the root with 1, its children by id from 2."""
    children = (
        relationships_snap.where(
            (F.col("destinationId") == ctx.root_concept)
            & (F.col("typeId") == ctx.is_a)
            & (F.col("active") == 1)
        )
        .select(F.col("sourceId").alias("conceptId"))
        .distinct()
    )
    root = spark.range(1).select(
        F.lit(ctx.root_concept).alias("conceptId"), F.lit(1).alias("displayOrder")
    )
    return root.unionByName(numbered(children, "conceptId", "displayOrder", 2, work))


def hierarchies(
    spark: SparkSession,
    relationships_snap: DataFrame,
    descriptions: DataFrame,
    languagerefsets: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """`(conceptId, fsn, term, displayOrder)`, names null where there is none.

    Descriptions and language refsets may be snapshots or histories; the latter are cut to
    the few components asked about before they are ranked. Small steps are stored before they
    meet a large table, so that their known size lets the planner broadcast them.
    """
    tops = work.write("top_concepts", top_concepts(spark, relationships_snap, ctx, work))
    latest = snapshot_naming(
        descriptions, "conceptId", tops.select("conceptId"), work, "top_components"
    )
    described = work.write("top_descriptions", latest.where("active = 1"))
    component = described.select(F.col("id").alias("referencedComponentId"))
    members = snapshot_naming(
        languagerefsets, "referencedComponentId", component, work, "top_members"
    )
    terms = (
        preferred_terms(described, members, ctx, active_members_only=True)
        .groupBy("conceptId")
        .agg(F.min_by("term", "id").alias("term"))
    )
    names = (
        described.where(
            (F.col("languageCode") == ctx.base_language)
            & (F.col("typeId") == ctx.fully_specified_name)
        )
        .groupBy("conceptId")
        .agg(F.min_by("term", "id").alias("fsn"))
    )
    return (
        tops.join(names, "conceptId", "left")
        .join(terms, "conceptId", "left")
        .select("conceptId", "fsn", "term", "displayOrder")
    )


def hierarchy_members(closure: DataFrame, hierarchies: DataFrame) -> DataFrame:
    """`(conceptId, hierarchyId)`: concepts below each hierarchy, itself included.

    Hierarchies are few and stored, so the planner cuts the closure without a shuffle;
    checks per hierarchy read this instead of the closure.
    """
    tops = hierarchies.select(F.col("conceptId").alias("hierarchyId"))
    return closure.join(tops, closure["supertypeId"] == tops["hierarchyId"]).select(
        F.col("subtypeId").alias("conceptId"), "hierarchyId"
    )
