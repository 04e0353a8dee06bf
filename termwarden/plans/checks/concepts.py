"""Checks on concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.functions.text import in_namespace
from termwarden.plans.checks.rowwise import descriptions_for
from termwarden.plans.release import Release

# Over the versions and the `active` flag of what the extension published.
NEW = "versions = 1 AND active = 1"
CHANGED = "versions > 1 AND active = 1"
INACTIVATED = "versions > 1 AND active = 0"


def new_concepts(release: Release) -> DataFrame:
    """New extension concepts per hierarchy, `(fsn, ct)` in display order."""
    return _per_hierarchy(release, _new_ids(release), "fsn")


def new_concepts_by_term(release: Release) -> DataFrame:
    """As `new_concepts`, labelled with the extension-language term: `(term, ct)`."""
    return _per_hierarchy(release, _new_ids(release), "term")


def new_concepts_by_status(release: Release) -> DataFrame:
    """New extension concepts per definition status, `(definitionStatusId, ct)`."""
    new = release.table("extension_changes").where(NEW)
    return new.groupBy("definitionStatusId").agg(F.count(F.lit(1)).alias("ct"))


def changed_concepts(release: Release) -> DataFrame:
    """Changed and inactivated extension concepts, `(label, ct)` in that order."""
    # The labels of the two counts.
    counts = release.table("extension_changes").agg(
        F.count_if(F.expr(CHANGED)).alias("changed"), F.count_if(F.expr(INACTIVATED)).alias("inactivated")
    )
    return counts.select(
        F.stack(
            F.lit(2),
            F.lit("changed"),
            F.col("changed"),
            F.lit("inactivated"),
            F.col("inactivated"),
        ).alias("label", "ct")
    )


def inactivated_concepts(release: Release) -> DataFrame:
    """Number of inactivated extension concepts, `(ct)`."""
    return release.table("extension_changes").agg(F.count_if(F.expr(INACTIVATED)).alias("ct"))


def promoted_concepts(release: Release) -> DataFrame:
    """Extension concepts the core module took over, `(id, fsn)`.

    Candidates are what the core module holds since the last base release; the history
    is cut to them, and is one conditional aggregate per id.
    """
    ctx = release.context
    time, module = F.col("effectiveTime"), F.col("moduleId")
    in_core = module == ctx.core_module
    in_extension = module == ctx.extension_module
    now_core = (
        release.table("concepts_snap2")
        .where(
            in_namespace(F.col("id"), ctx.promoted_namespaces)
            & in_core
            & (time > ctx.base_release_date)
        )
        .select("id", "fsn")
    )
    earlier = (time < ctx.release_date) | (time <= ctx.base_release_date)
    history = (
        release.table("concepts")
        .where(earlier & (in_core | in_extension))
        .join(now_core.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(
            F.bool_or(in_core & (time <= ctx.base_release_date)).alias("core_before"),
            F.bool_or(in_extension & (time < ctx.release_date)).alias("extension_before"),
        )
        .where("extension_before AND NOT core_before")
    )
    return now_core.join(history.select("id"), "id", "left_semi")


def non_translated(release: Release) -> DataFrame:
    """Active concepts without an active extension-language term, per hierarchy."""
    translated = (
        release.table("descriptions_snap")
        .where(
            (F.col("active") == 1)
            & (F.col("languageCode") == release.context.extension_language)
        )
        .select(F.col("conceptId").alias("id"))
        .distinct()
    )
    active = release.table("concepts_snap").where("active = 1").select("id")
    return _per_hierarchy(release, active.join(translated, "id", "left_anti"), "fsn")


def _new_ids(release: Release) -> DataFrame:
    return release.table("extension_changes").where(NEW).select("id")


def _per_hierarchy(release: Release, ids: DataFrame, label: str) -> DataFrame:
    """Count concepts under every hierarchy they belong to, `(label, ct)` in order.

    Which concepts those are is stored; labels come in after the count.
    """
    hierarchies = release.table("hierarchies")
    below = release.table("hierarchy_members")
    counts = (
        ids.join(below.select(F.col("conceptId").alias("id"), "hierarchyId"), "id")
        .groupBy(F.col("hierarchyId").alias("conceptId"))
        .agg(F.count(F.lit(1)).alias("ct"))
    )
    labelled = counts.join(hierarchies, "conceptId")
    return release.in_order(labelled, "displayOrder").select(label, "ct")


def identifiers_outside_namespace(release: Release) -> DataFrame:
    """Active extension rows whose identifier is not one of the extension's.

    `(typ, id, term, effectiveTime)`, all text but the date. The kinds differ in `typ`
    and rows of a kind in their key, so the union has no duplicates to remove.
    """
    ctx = release.context

    def labelled(kind: str, rows: DataFrame, term: Column) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("typ"),
            F.col("id").cast("string").alias("id"),
            term.cast("string").alias("term"),
            "effectiveTime",
        )

    def part(kind: str, table: str, tested: str, term: Column) -> DataFrame:
        found = release.table(table).where(
            (F.col("moduleId") == ctx.extension_module)
            & (F.col("active") == 1)
            & ~in_namespace(F.col(tested), ctx.namespaces)
        )
        return labelled(kind, found, term)

    component = "referencedComponentId"
    axiom = F.concat_ws(" : ", F.col(component).cast("string"), F.col("owlExpression"))
    # What the kinds are called in the result.
    return (
        part("begrepp", "concepts_snap2", "id", F.col("fsn"))
        .unionByName(
            labelled("beskrivning", descriptions_for(release, "se-module-with-non-se-ids"), F.col("term"))
        )
        .unionByName(part("relation", "relationships_snap", "id", F.col("sourceId")))
        .unionByName(
            part("lang-refset", "languagerefsets_snap", component, F.col(component))
        )
        .unionByName(part("axiom", "owlrefsets", component, axiom))
    )
