"""Release packages: tab-separated files in the folders of the release format.

A release is made of a base package and, mostly, an extension package. Files have a
header line, no quoting and no escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from termwarden.operators.versions import LATEST, first_loaded, marked
from termwarden.schemas import FULL_TABLES, SNAPSHOT_PACKAGE_TABLES

# Where the release format keeps the file of each table, below the folder
# of its kind (Full or Snapshot).
FILE_OF_TABLE = {
    "concepts": "Terminology/{beta}sct2_Concept_{kind}_{scope}.txt",
    "descriptions": "Terminology/{beta}sct2_Description_{kind}-{language}_{scope}.txt",
    "relationships": "Terminology/{beta}sct2_Relationship_{kind}_{scope}.txt",
    "stated": "Terminology/{beta}sct2_StatedRelationship_{kind}_{scope}.txt",
    "owlrefsets": "Terminology/{beta}sct2_sRefset_OWLExpression{kind}_{scope}.txt",
    "languagerefsets": "Refset/Language/{beta}der2_cRefset_Language{kind}-{language}_{scope}.txt",
    "refsetdescriptors": "Refset/Metadata/{beta}der2_cciRefset_RefsetDescriptor{kind}_{scope}.txt",
    "simplerefsets": "Refset/Content/{beta}der2_Refset_*",
}

# The package folder is named product_kind_status_scope, the scope being
# a date or, for an extension, a namespace and a date; beta packages start with x.
PACKAGE_NAME = r"(?:^|/)(x?)[^_/]+_[^_/]+_[^_/]+_((?:[A-Z]{2}\d+_)?(\d{8}))T[^/]*(?:/|$)"

_ORDER = ("_package", "_file", "_path", "_block", "_row")


@dataclass(frozen=True)
class Package:
    """A package folder with what its name says."""

    path: str
    scope: str
    date: int
    beta: str
    languages: tuple[str, ...] = ("en",)
    without: frozenset[str] = frozenset()

    @classmethod
    def base(
        cls, path: str, languages: Sequence[str] = ("en",), without: Iterable[str] = ()
    ) -> Package:
        """A base package; `without` names tables it has no files of.

        A missing file is an error otherwise: an empty table in its place would let checks
        find nothing wrong.
        """
        beta, date = _identify(path)
        date_only = int(date[-8:])
        return cls(path, f"INT_{date}", date_only, beta, tuple(languages), frozenset(without))

    @classmethod
    def extension(
        cls, path: str, languages: Sequence[str] = ("en", "sv"), without: Iterable[str] = ()
    ) -> Package:
        beta, scope = _identify(path)
        date_only = int(scope[-8:])
        return cls(path, scope, date_only, beta, tuple(languages), frozenset(without))

    def files(self, table: str, kind: str) -> list[str]:
        """Paths of a table's files in load order, one per language if it has several."""
        if table in self.without:
            return []
        pattern = f"{self.path}/{kind}/{FILE_OF_TABLE[table]}"
        languages = self.languages if "{language}" in pattern else ("",)
        return [
            pattern.format(beta=self.beta, kind=kind, scope=self.scope, language=language)
            for language in languages
        ]


def release_name(base: Package, extension: Package | None = None) -> str:
    """Name of the release the packages make up."""
    if extension:
        return f"{extension.beta}snomed_full_{extension.scope}"
    return f"snomed_full_{base.date}"


def package_columns(path: Column) -> dict[str, Column]:
    """What the package folder in a file path says, as columns."""
    return {
        "package": F.regexp_extract(path, PACKAGE_NAME, 2),
        "packageDate": F.regexp_extract(path, PACKAGE_NAME, 3).try_cast("int"),
        "beta": F.regexp_extract(path, PACKAGE_NAME, 1) == "x",
    }


def load_full(
    spark: SparkSession,
    table: str,
    base: Package,
    extension: Package | None = None,
    since: int | None = None,
    marks: bool = False,
) -> DataFrame:
    """All versions of a table, base package first; one row per id and date.

    With `since` only those after that date, for a release that is added to another; with
    `marks` latest versions are marked.
    """
    loaded = read_files(spark, table, "Full", base, extension, FULL_TABLES[table])
    if since is not None:
        loaded = loaded.where(F.col("effectiveTime") > since)
    if marks:
        return marked(loaded, _ORDER).select(*FULL_TABLES[table].names, LATEST)
    return first_loaded(loaded, _ORDER).select(*FULL_TABLES[table].names)


def load_snapshot(
    spark: SparkSession, table: str, base: Package, extension: Package | None = None
) -> DataFrame:
    """Rows of a snapshot package, base package first; one row per component.

    Language refsets have no key there and keep every row.
    """
    schema = SNAPSHOT_PACKAGE_TABLES[table]
    loaded = read_files(spark, table, "Snapshot", base, extension, schema)
    if table != "languagerefsets":
        loaded = first_loaded(loaded, _ORDER, ("id",))
    return loaded.select(*schema.names)


def read_files(
    spark: SparkSession,
    table: str,
    kind: str,
    base: Package,
    extension: Package | None,
    schema: StructType,
) -> DataFrame:
    """A table's rows from both packages, with columns that give their load order.

    Order within a file follows from the start of the block a row is read from and its
    place in it, so splitting large files over tasks keeps it.
    """
    parts = [
        _read(spark, path, schema, package, file)
        for package, source in enumerate(filter(None, (base, extension)))
        for file, path in enumerate(source.files(table, kind))
    ]
    if not parts:
        empty = spark.createDataFrame([], schema)
        return empty.withColumns({name: F.lit(None) for name in _ORDER})
    return reduce(DataFrame.unionByName, parts)


def _read(
    spark: SparkSession,
    path: str,
    schema: StructType,
    package: int,
    file: int,
) -> DataFrame:
    reader = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("escape", "")
        .option("mode", "FAILFAST")
    )
    rows = reader.csv(path)
    blanks = {
        field.name: F.coalesce(field.name, F.lit(""))
        for field in schema
        if isinstance(field.dataType, StringType)
    }
    # Where a pattern stands for several files, rows carry their path and are ordered by it:
    # the plan does not grow with the number of files, nor are they listed in the driver.
    several = F.col("_metadata.file_path") if "*" in path else F.lit("")
    position = {
        "_package": F.lit(package),
        "_file": F.lit(file),
        "_path": several,
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    }
    return rows.withColumns(position | blanks)


def _identify(path: str) -> tuple[str, str]:
    """Beta mark and scope from a package path."""
    found = re.search(PACKAGE_NAME, path.rstrip("/").rpartition("/")[2])
    if not found:
        raise ValueError(f"not a release package: {path}")
    return found[1], found[2]
