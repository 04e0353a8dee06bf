"""Checks on simple and language reference sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.operators.skew import repeat_rows, split_join
from termwarden.plans.checks.rowwise import descriptions_for
from termwarden.plans.release import Release


def refsets_with_inactive(release: Release) -> DataFrame:
    """Refsets with active members that point at inactive concepts.

    `(refsetId, term, ct)`; a count is multiplied by the language-refset rows that mark
    the term.
    """
    named = _term_counts(release).join(_inactive_members(release), "refsetId")
    return named.select("refsetId", "term", (F.col("n") * F.col("marks")).alias("ct"))


def refsets_with_or_without_inactive(release: Release) -> DataFrame:
    """As `refsets_with_inactive`, with refsets that have no such member as zero."""
    counted = _term_counts(release).join(_inactive_members(release), "refsetId", "left")
    found = F.coalesce("n", F.lit(0)) * F.col("marks")
    return counted.select("refsetId", "term", found.alias("ct"))


def inactive_concepts_in_refsets(release: Release) -> DataFrame:
    """Inactive concepts among the active members of named refsets, by refset.

    `(refsetId, term, id)`, once per language-refset row that marks the term. Members are
    cut to the named refsets first. Members and repetitions are part of the order,
    so that equal rows do not have to meet in one sort partition.
    """
    members = (
        release.table("simplerefsets_snap")
        .where("active = 1")
        .select(F.col("id").alias("member"), "refsetId", "referencedComponentId")
    )
    named = split_join(
        members,
        release.table("refset_terms"),
        ["refsetId"],
        release.table("hot_simple_refsets"),
        spread="member",
    )
    inactive = (
        release.table("concepts_snap")
        .where("active = 0")
        .select(F.col("id").alias("referencedComponentId"))
    )
    labelled = split_join(
        named,
        inactive,
        ["referencedComponentId"],
        release.table("hot_simple_members"),
        spread="member",
        how="left_semi",
    )
    repeated = repeat_rows(labelled, "marks", "place")
    order = ("refsetId", "term", "referencedComponentId", "member", "place")
    return release.in_order(repeated, *order).select(
        "refsetId", "term", F.col("referencedComponentId").alias("id")
    )


def concept_descriptions(release: Release, params: DataFrame | None = None) -> DataFrame:
    """Extension descriptions of a concept with its name, `(param, id, term, fsn)`."""
    concepts = release.table("concepts_snap2").select(
        F.col("id").alias("conceptId"), "fsn"
    )
    if params is not None:
        concepts = concepts.join(
            params, concepts["conceptId"] == params["param"], "left_semi"
        )
    terms = (
        release.table("descriptions_snap")
        .where(F.col("moduleId") == release.context.extension_module)
        .select("id", "conceptId", "term")
    )
    joined = split_join(
        terms, concepts, ["conceptId"], release.table("hot_concepts_described"), spread="id"
    )
    concept = F.col("conceptId")
    return joined.select(concept.alias("param"), concept.alias("id"), "term", "fsn")


def base_language_members(release: Release) -> DataFrame:
    """Active language-refset members on active base-language extension descriptions.

    `(term, referencedComponentId, refsetId)`, without the base language refsets.
    """
    ctx = release.context
    members = (
        release.table("languagerefsets_snap")
        .where(
            (F.col("active") == 1) & ~F.col("refsetId").isin(*ctx.excluded_language_refsets)
        )
        .select("id", "referencedComponentId", "refsetId")
    )
    found = descriptions_for(release, "active-langrefset-en-descriptions")
    descriptions = found.select(F.col("id").alias("referencedComponentId"), "term")
    joined = split_join(
        members,
        descriptions,
        ["referencedComponentId"],
        release.table("hot_language_members"),
        spread="id",
    )
    return joined.select("term", "referencedComponentId", "refsetId")


def members_on_inactive_descriptions(release: Release) -> DataFrame:
    """Number of active language-refset members on inactive descriptions, `(ct)`."""
    members = (
        release.table("languagerefsets_snap")
        .where("active = 1")
        .groupBy(F.col("referencedComponentId").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inactive = release.table("descriptions_snap").where("active = 0").select("id")
    return members.join(inactive, "id", "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("ct")
    )


def repeated_members(release: Release) -> DataFrame:
    """Active descriptions an active language refset holds more than once.

    `(refsetId, fsn, referencedComponentId, term)`. Ids are unique in the joined
    snapshots, so members can be counted before the joins.
    """
    ctx = release.context
    repeated = (
        release.table("languagerefsets_snap")
        .where((F.col("active") == 1) & (F.col("moduleId") == ctx.extension_module))
        .groupBy("refsetId", "referencedComponentId")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    descriptions = (
        release.table("descriptions_snap")
        .where("active = 1")
        .select(F.col("id").alias("referencedComponentId"), "term")
    )
    refset_names = release.table("refset_concepts").where("active = 1")
    named = split_join(
        repeated,
        refset_names.select("refsetId", "fsn"),
        ["refsetId"],
        release.table("hot_language_refsets"),
        spread="referencedComponentId",
    )
    return (
        named.join(descriptions, "referencedComponentId")
        .select("refsetId", "fsn", "referencedComponentId", "term")
    )


def members_of_repeated_components(
    release: Release, params: DataFrame | None = None
) -> DataFrame:
    """Active members and descriptions of components a refset holds more than once.

    `(param, member_*, desc_*)`; whether a component is held more than once does not
    depend on the members being active. Descriptions are joined with the repeated
    components, one row each, before the members are.
    """
    members = release.table("languagerefsets_snap")
    descriptions = release.table("descriptions_snap")
    key = ["refsetId", "referencedComponentId"]
    counted = members
    if params is not None:
        wanted = params.select(F.col("param").alias("refsetId"))
        large_refsets = release.table("hot_language_refsets")
        counted = split_join(
            members, wanted, ["refsetId"], large_refsets, spread="id", how="left_semi"
        )
    repeated = (
        counted.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    )
    desc_side = descriptions.where("active = 1").select(
        F.col("id").alias("referencedComponentId"), *_prefixed(descriptions, "desc_")
    )
    joined = split_join(
        members.where("active = 1"),
        repeated.join(desc_side, "referencedComponentId"),
        key,
        release.table("hot_language_members"),
        spread="id",
    )
    return joined.select(
        F.col("refsetId").alias("param"),
        *_prefixed(members, "member_"),
        *(f"desc_{name}" for name in descriptions.columns),
    )


def refsets_without_descriptor(release: Release) -> DataFrame:
    """Named refset concepts that no refset descriptor refers to, `(id, fsn)`."""
    described = (
        release.table("refsetdescriptors_snap")
        .select(F.col("referencedComponentId").alias("id"))
        .distinct()
    )
    named = release.table("refset_concepts").select(F.col("refsetId").alias("id"), "fsn")
    return named.join(described, "id", "left_anti")


def refsets_not_concepts(release: Release) -> DataFrame:
    """Simple refsets with active members whose id is no active concept, ordered.

    The concepts are cut to the refset ids first, by a join with a small stored table,
    so that the anti join has two small sides.
    """
    used = (
        release.table("refsets")
        .where("kind = 'simple' AND activeMembers > 0")
        .select("refsetId")
    )
    concepts = (
        release.table("concepts_snap")
        .where("active = 1")
        .select(F.col("id").alias("refsetId"))
        .join(used, "refsetId", "left_semi")
    )
    return release.in_order(used.join(concepts, "refsetId", "left_anti"), "refsetId")


def _inactive_members(release: Release) -> DataFrame:
    """Active members on inactive concepts per refset, `(refsetId, n)`."""
    members = (
        release.table("simplerefsets_snap")
        .where("active = 1")
        .groupBy("refsetId", F.col("referencedComponentId").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inactive = release.table("concepts_snap").where("active = 0").select("id")
    return (
        members.join(inactive, "id", "left_semi")
        .groupBy("refsetId")
        .agg(F.sum("n").alias("n"))
    )


def _term_counts(release: Release) -> DataFrame:
    """Terms of named refsets with the number of rows that mark them."""
    terms = release.table("refset_terms")
    if not release.context.collation:
        return terms
    marks = F.sum("marks").alias("marks")
    return release.context.group_by_text(terms, ["refsetId"], "term", marks)


def _prefixed(df: DataFrame, prefix: str) -> list:
    return [F.col(name).alias(f"{prefix}{name}") for name in df.columns]
