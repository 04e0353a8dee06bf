"""Reference sets in use, and what they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.operators.names import preferred_terms
from termwarden.sources.scratch import WorkFolder


def refsets_in_use(members: dict[str, DataFrame]) -> DataFrame:
    """One row per refset of the given member tables.

    `(kind, refsetId, members, activeMembers)`. A refset may hold any share of the
    members; the counts are combined before the shuffle.
    """
    parts = [
        df.groupBy("refsetId")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(F.col("active") == 1).alias("activeMembers"),
        )
        .select(F.lit(kind).alias("kind"), "refsetId", "members", "activeMembers")
        for kind, df in members.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def refset_terms(
    refsets: DataFrame,
    descriptions_snap: DataFrame,
    languagerefsets_snap: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """Preferred terms of simple refsets with active members, `(refsetId, term, marks)`.

    `marks` counts the language-refset rows that mark the term, inactive ones included.
    """
    used = refsets.where("kind = 'simple' AND activeMembers > 0").select(
        F.col("refsetId").alias("conceptId")
    )
    described = work.write(
        "refset_descriptions", descriptions_snap.join(used, "conceptId", "left_semi")
    )
    terms = preferred_terms(described, languagerefsets_snap, ctx, active_members_only=False)
    return terms.groupBy(F.col("conceptId").alias("refsetId"), "term").agg(
        F.sum("marks").alias("marks")
    )


def refset_concepts(refsets: DataFrame, concepts_snap2: DataFrame) -> DataFrame:
    """Named concepts that are refsets in use, `(refsetId, fsn, active)`."""
    used = refsets.select(F.col("refsetId").alias("id")).distinct()
    return concepts_snap2.join(used, "id", "left_semi").select(
        F.col("id").alias("refsetId"), "fsn", "active"
    )
