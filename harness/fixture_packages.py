"""Release packages written from the derived tables, to be loaded again.

Each file of the release format becomes a folder of that name; its part files are in the
order of the raw rows, so that the load order is the one the oracle uses.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import fixtures
from termwarden.context import CORE_MODULE
from termwarden.operators.versions import snapshot
from termwarden.schemas import FULL_TABLES
from termwarden.sources.packages import Package
from termwarden.sources.scratch import WorkFolder

BASE_FOLDER = "Terminology_InternationalRF2_PRODUCTION_19990731T120000Z"
EXTENSION_FOLDER = "xTerminology_ExtensionSE_PRODUCTION_SE1000052_20000531T120000Z"


class FixturePackages:
    """A base and an extension package below one folder; tables are written on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        folder = WorkFolder(spark).path
        self.base = Package.base(f"{folder}/{BASE_FOLDER}")
        self.extension = Package.extension(f"{folder}/{EXTENSION_FOLDER}")
        self._written: set[tuple[str, str]] = set()

    def provide(self, table: str, kind: str) -> FixturePackages:
        """Make sure that the files of a table exist."""
        if (table, kind) not in self._written:
            parts = self._full(table) if kind == "Full" else self._snapshot(table)
            for path, rows, order in parts:
                _write(path, rows, order, "none" if kind == "Full" else "gzip")
            self._written.add((table, kind))
        return self

    def _full(self, table: str) -> Iterator[tuple[str, DataFrame, tuple[str, ...]]]:
        raw = fixtures.completed(fixtures.raw_table(self.spark, self.sf_dir, table), table)
        columns = FULL_TABLES[table].names
        order = fixtures.LOAD_ORDER[table]
        rows = raw.select(*columns, *(c for c in order if c not in columns))
        for file, path in enumerate(self._paths(table, "Full")):
            yield path, rows.where(_file_of(table) == file), order

    def _snapshot(self, table: str) -> Iterator[tuple[str, DataFrame, tuple[str, ...]]]:
        source = "relationships" if table == "stated" else table
        paths = self._paths(table, "Snapshot")
        work = WorkFolder(self.spark)
        latest = fixtures.snapshot_table(self.spark, self.sf_dir, source)
        if len(paths) > 2:
            # Several files are cut from it.
            latest = work.write(table, latest)
        full = fixtures.full_table(self.spark, self.sf_dir, source)
        earlier = snapshot(
            full.where(
                (F.col("moduleId") == CORE_MODULE)
                & (F.col("effectiveTime") <= fixtures.CONTEXT.base_release_date)
            )
        )
        for file, path in enumerate(paths):
            rows = earlier if file == 0 else latest
            language = path.rpartition("/")[2].partition("-")[2][:2]
            yield path, rows.where(_language_of(source) == language) if language else rows, ()
        work.delete()

    def _paths(self, table: str, kind: str) -> list[str]:
        """Files of a table in load order."""
        base, extension = (p.files(table, kind) for p in (self.base, self.extension))
        if table == "simplerefsets":
            names = [p[0].removesuffix("*") + "Simple{}Full.txt" for p in (base, extension)]
            return [names[0].format(""), names[1].format("A"), names[1].format("B")]
        return [*base, *extension]


def _file_of(table: str) -> Column:
    """Number of the file a row of a full table goes to."""
    in_core = F.col("moduleId") == CORE_MODULE
    if table in ("concepts", "relationships"):
        return F.when(in_core, 0).otherwise(1)
    if table in ("descriptions", "languagerefsets"):
        return F.when(_language_of(table) == "sv", 2).when(in_core, 0).otherwise(1)
    if table == "simplerefsets":
        group = F.expr(f"refsetId div {fixtures.PLACE}")
        return F.when(group % 2 == 0, 0).when(group < 6, 1).otherwise(2)
    number = F.expr(f"referencedComponentId div {fixtures.PLACE}")
    divisor = 2 if table == "refsetdescriptors" else 3
    return F.when(number % divisor == 0, 0).otherwise(1)


def _language_of(table: str) -> Column:
    if table == "descriptions":
        return F.col("languageCode")
    line = F.expr(f"referencedComponentId div {fixtures.PLACE} % 10")
    return F.when(line % 2 == 1, "en").otherwise("sv")


def _write(path: str, rows: DataFrame, order: tuple[str, ...], compression: str) -> None:
    if order:
        columns = [c for c in rows.columns if not c.startswith(("o_", "l_"))]
        rows = rows.orderBy(*order).select(*columns)
    (
        rows.write.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("escapeQuotes", False)
        .option("compression", compression)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
