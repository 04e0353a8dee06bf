"""Checks that look at one active extension description at a time.

Alone, such a check is a filter over the descriptions. When many checks run, the
descriptions are read once for all of these: rows are tagged with the checks they concern
and stored by check, and each check then reads its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.functions.text import has_irregular_characters, has_stray_spaces, in_namespace
from termwarden.plans.release import Release

#: What each check looks for, by its id.
CONDITIONS: dict[str, Callable[[CheckContext], Column]] = {
    "funky-chars": lambda ctx: has_irregular_characters(F.col("term")),
    "descriptions-spaces": lambda ctx: has_stray_spaces(F.col("term")),
    "se-module-with-non-se-ids": lambda ctx: ~in_namespace(F.col("id"), ctx.namespaces),
    "active-langrefset-en-descriptions": lambda ctx: F.col("languageCode") == ctx.base_language,
}

COLUMNS = ("id", "effectiveTime", "conceptId", "languageCode", "term")


def extension_descriptions(release: Release) -> DataFrame:
    """Active descriptions of the extension's module."""
    return release.table("descriptions_snap").where(
        (F.col("active") == 1) & (F.col("moduleId") == release.context.extension_module)
    )


def descriptions_for(release: Release, check_id: str) -> DataFrame:
    """The rows a check looks for: of the shared scan if there was one."""
    shared = release.shared
    if shared is not None:
        return shared.where(F.col("check_id") == check_id).select(*COLUMNS)
    condition = CONDITIONS[check_id](release.context)
    return extension_descriptions(release).where(condition).select(*COLUMNS)


def sharing_scans(release: Release) -> Release:
    """This release with the rows of all these checks found in one scan and stored."""
    if release.shared is not None:
        return release

    def tagged() -> DataFrame:
        tags = [
            F.when(condition(release.context), F.lit(check_id))
            for check_id, condition in CONDITIONS.items()
        ]
        found = F.explode(F.array_compact(F.array(*tags))).alias("check_id")
        return extension_descriptions(release).select(*COLUMNS, found)

    other = copy(release)
    other.shared = release.kept("rowwise", tagged, ("check_id",))
    return other
