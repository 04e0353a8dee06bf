"""What a check needs to know about the release it runs on."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termwarden.functions.dates import previous_base_release, release_date_of

# Identifiers of the terminology's own metadata concepts and of the
# national extension the default catalogue is set up for.
EXTENSION_MODULE = 45991000052106
CORE_MODULE = 900000000000207008
NAMESPACES = ("1000052", "1000057")
PROMOTED_NAMESPACES = ("1000052",)
EXTENSION_LANGUAGE = "sv"
BASE_LANGUAGE = "en"
PREFERRED = 900000000000548007
EXTENSION_LANGUAGE_REFSET = 46011000052107
EXCLUDED_LANGUAGE_REFSETS = (900000000000509007, 900000000000508004)
IS_A = 116680003
FULLY_SPECIFIED_NAME = 900000000000003001
ROOT_CONCEPT = 138875005


#: Fields that stored tables are built with: another value needs another build.
STORED_FIELDS = frozenset(
    {
        "release_date",
        "extension_module",
        "extension_language",
        "base_language",
        "preferred",
        "is_a",
        "fully_specified_name",
        "root_concept",
    }
)


@dataclass(frozen=True)
class CheckContext:
    """Release dates and extension identifiers; every default can be overridden."""

    release_date: int
    base_release_date: int
    extension_module: int = EXTENSION_MODULE
    core_module: int = CORE_MODULE
    namespaces: tuple[str, ...] = NAMESPACES
    promoted_namespaces: tuple[str, ...] = PROMOTED_NAMESPACES
    extension_language: str = EXTENSION_LANGUAGE
    base_language: str = BASE_LANGUAGE
    preferred: int = PREFERRED
    extension_language_refset: int = EXTENSION_LANGUAGE_REFSET
    excluded_language_refsets: tuple[int, ...] = EXCLUDED_LANGUAGE_REFSETS
    is_a: int = IS_A
    fully_specified_name: int = FULLY_SPECIFIED_NAME
    root_concept: int = ROOT_CONCEPT
    collation: str | None = None

    @classmethod
    def for_release(cls, name: str, **overrides) -> CheckContext:
        """Context of a named release; both dates follow from the name."""
        date = release_date_of(name)
        dates = {"release_date": date, "base_release_date": previous_base_release(date)}
        return cls(**(dates | overrides))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CheckContext:
        values = json.loads(text)
        for field in fields(cls):
            if isinstance(values.get(field.name), list):
                values[field.name] = tuple(values[field.name])
        return cls(**values)

    def reopened(self, overrides: dict) -> CheckContext:
        """This context of stored tables with other values for what only checks read."""
        differing = sorted(
            name
            for name in STORED_FIELDS & overrides.keys()
            if overrides[name] != getattr(self, name)
        )
        if differing:
            raise ValueError(f"the stored tables were built with another {', '.join(differing)}")
        return replace(self, **overrides)

    def at_release(self, name: str, overrides: dict) -> CheckContext:
        """This context at the dates of another release, for tables that are built on these."""
        date = release_date_of(name)
        dates = {"release_date": date, "base_release_date": previous_base_release(date)}
        return replace(self.reopened(overrides), **dates)

    def text_key(self, col: Column) -> Column:
        """`col` as a comparison key: binary, or under the configured collation."""
        return F.collate(col, self.collation) if self.collation else col

    def group_by_text(
        self, df: DataFrame, keys: Sequence[str], text: str, *aggregates: Column
    ) -> DataFrame:
        """Aggregate by `keys` and a text, which a collated group shows its least form of.

        Only the latter costs an aggregate over strings.
        """
        if not self.collation:
            return df.groupBy(*keys, text).agg(*aggregates)
        key = self.text_key(F.col(text)).alias("_text")
        shown = F.min(text).alias(text)
        return df.groupBy(*keys, key).agg(shown, *aggregates).drop("_text")
