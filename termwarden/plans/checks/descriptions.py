"""Checks on descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.operators import terms
from termwarden.operators.skew import split_join
from termwarden.plans.checks.rowwise import descriptions_for
from termwarden.plans.release import Release


def description_changes(release: Release) -> DataFrame:
    """New translations, new synonyms and inactivated descriptions, `(label, ct)`."""
    # The labels of the three counts.
    parts = {
        "new translations": new_translations(release),
        "new synonyms": new_synonyms(release),
        "inactivated descriptions": inactivated_descriptions(release),
    }
    labelled = [
        df.select(F.lit(place).alias("place"), F.lit(label).alias("label"), "ct")
        for place, (label, df) in enumerate(parts.items())
    ]
    result = labelled[0].unionByName(labelled[1]).unionByName(labelled[2])
    return release.in_order(result, "place").select("label", "ct")


def new_translations(release: Release) -> DataFrame:
    """Translations the extension first published at the release, `(ct)`.

    Only those of concepts some version of which lies outside the extension. The history
    is cut to the descriptions of the release before it is searched for earlier versions.
    """
    ctx = release.context
    time = F.col("effectiveTime")
    own = release.table("descriptions").where(F.col("moduleId") == ctx.extension_module)
    published = own.where(
        (time == ctx.release_date)
        & (F.col("languageCode") == ctx.extension_language)
        & (F.col("active") == 1)
    ).select("id", "conceptId")
    earlier = (
        own.where(time < ctx.release_date)
        .select("id")
        .join(published.select("id"), "id", "left_semi")
        .distinct()
    )
    per_concept = (
        published.join(earlier, "id", "left_anti")
        .groupBy("conceptId")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    elsewhere = (
        release.table("concepts")
        .where(F.col("moduleId") != ctx.extension_module)
        .select(F.col("id").alias("conceptId"))
        .join(per_concept.select("conceptId"), "conceptId", "left_semi")
        .distinct()
    )
    return _total(per_concept.join(elsewhere, "conceptId", "left_semi"), F.col("n"))


def new_synonyms(release: Release) -> DataFrame:
    """Active descriptions of the release whose concept has several current terms.

    The terms are active ones in the extension language; the counted descriptions may
    be in any language and module. The snapshot is cut to the release's concepts first.
    """
    ctx = release.context
    published = _published_per_concept(release)
    several = (
        release.table("descriptions_snap")
        .where((F.col("active") == 1) & (F.col("languageCode") == ctx.extension_language))
        .select("conceptId")
        .join(published.select("conceptId"), "conceptId", "left_semi")
        .groupBy("conceptId")
        .agg(F.count(F.lit(1)).alias("terms"))
        .where("terms > 1")
    )
    return _total(published.join(several, "conceptId", "left_semi"), F.col("n"))


def new_synonyms_over_history(release: Release) -> DataFrame:
    """As `new_synonyms`, but counting all versions of the terms: `(ct)`.

    Their numbers are stored with the release, so that the history is not read again.
    """
    several = release.table("language_terms").where("terms > 1").select("conceptId")
    published = _published_per_concept(release)
    return _total(published.join(several, "conceptId"), F.col("n"))


def _published_per_concept(release: Release) -> DataFrame:
    """Active descriptions the release published, `(conceptId, n)`."""
    published = (F.col("active") == 1) & (F.col("effectiveTime") == release.context.release_date)
    return (
        release.table("descriptions")
        .where(published)
        .groupBy("conceptId")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def inactivated_descriptions(release: Release) -> DataFrame:
    """Extension-language descriptions inactivated by the release, `(ct)`."""
    ctx = release.context
    return (
        release.table("descriptions")
        .where(
            (F.col("moduleId") == ctx.extension_module)
            & (F.col("effectiveTime") == ctx.release_date)
            & (F.col("languageCode") == ctx.extension_language)
            & (F.col("active") == 0)
        )
        .agg(F.count(F.lit(1)).alias("ct"))
    )


def irregular_characters(release: Release) -> DataFrame:
    """Terms with characters that terms should not have."""
    found = descriptions_for(release, "funky-chars").select("id", "conceptId", "term", "languageCode")
    return release.in_order(found, "languageCode", "term", "id")


def stray_spaces(release: Release) -> DataFrame:
    """Terms with leading, trailing or repeated whitespace, `(id, term)`."""
    return descriptions_for(release, "descriptions-spaces").select("id", "term")


def duplicate_terms(release: Release) -> DataFrame:
    """Preferred terms several descriptions share within a semantic tag.

    `(term, semtag, ct)`, most frequent first. Terms are compared exactly, tags under
    the configured collation. A description counts once per language-refset row.
    """
    ctx = release.context
    marks = (
        release.table("languagerefsets_snap")
        .where(
            (F.col("active") == 1)
            & (F.col("refsetId") == ctx.extension_language_refset)
            & (F.col("acceptabilityId") == ctx.preferred)
        )
        .groupBy(F.col("referencedComponentId").alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_concept = (
        release.table("descriptions_snap")
        .where((F.col("active") == 1) & (F.col("languageCode") == ctx.extension_language))
        .select("id", "conceptId", "term")
        .join(marks, "id")
        .groupBy("conceptId", "term")
        .agg(F.sum("n").alias("n"))
    )
    tags = (
        release.table("concepts_snap2")
        .where("active = 1")
        .select(F.col("id").alias("conceptId"), "semtag")
    )
    counts = ctx.group_by_text(
        per_concept.join(tags, "conceptId"), ["term"], "semtag", F.sum("n").alias("ct")
    )
    repeated = counts.where("ct > 1").select("term", "semtag", "ct")
    return release.in_order(repeated, F.desc("ct"), "term", "semtag")


def concepts_with_term(release: Release, params: DataFrame | None = None) -> DataFrame:
    """Active concepts by active extension term, `(param, id, term, fsn)`.

    With `params` those of the terms in its column `param`, under the configured
    comparison. Frequent terms are told by their comparison key, whatever their spellings.
    """
    index = release.by_term("term_index")
    if params is not None:
        wanted = terms.keys_of(params, release.by_term("term_keys"), release.context)
        hot = release.by_term("hot_terms")
        index = split_join(index, wanted, ["key"], hot, spread="id", how="left_semi")
    return index.select(
        F.col("term").alias("param"), F.col("conceptId").alias("id"), "term", "fsn"
    )


def concepts_of_term(release: Release, term: str) -> DataFrame:
    """`concepts_with_term` of one term: read from where the index has its key."""
    key = terms.key_of(term, release.by_term("term_keys"), release.context)
    found = release.by_term("term_index").where(F.col("key") == F.lit(key).cast("string"))
    return found.select(F.col("conceptId").alias("id"), "term", "fsn")


def _total(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("ct"))
