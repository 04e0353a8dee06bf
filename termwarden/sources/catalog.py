"""Releases as databases of the session catalog, with tables bucketed on their ids.

Each build of a release is a database of its own. Another database, named after the release,
has views on the tables of the build that is listed, so that they can also be queried with
SQL as `<release>.<table>`; which build that is, is a property of this database, set in one
step. Readers that opened a build go on with it while the next one is made.

Snapshots are bucketed by component id, language refsets by the component they refer to
and the closure by subtype: joins on those columns need no shuffle of the bucketed side,
and none at all between two of them. A column is left out if one value may fill a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termwarden.schemas import FULL_TABLES
from termwarden.sources.store import RELEASE_NAME, WRITING, Listing, Store, matching_releases

BUCKET_COLUMNS = {
    "concepts_snap": "id",
    "concepts_snap2": "id",
    "descriptions_snap": "id",
    "languagerefsets_snap": "referencedComponentId",
    "transitiveclosure": "subtypeId",
}

#: Table of a complete build that holds its context, and the property that names a build.
LISTING = "release_info"
BUILD_PROPERTY = "termwarden.build"


class CatalogStore(Store):
    """Tables of one or more releases in databases below one location."""

    def __init__(self, spark: SparkSession, location: str, buckets: int) -> None:
        self.spark = spark
        self.location = location.rstrip("/")
        self.buckets = buckets

    @staticmethod
    def database(release: str, build: str) -> str:
        return f"{release}__{build}"

    def write(
        self,
        table: str,
        release: str,
        build: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        gather: bool = False,
    ) -> DataFrame:
        """Store a table of a build and return it as stored."""
        schema = df.schema
        database = self.database(release, build)
        self.spark.sql(
            f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{self.location}/{database}'"
        )
        bucket = BUCKET_COLUMNS.get(table)
        if bucket:
            df = df.repartition(self.buckets, bucket)
        elif gather:
            df = df.hint("rebalance", *partition_by)
        writer = df.write.mode("overwrite").format("parquet").options(**WRITING)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket:
            writer = writer.bucketBy(self.buckets, bucket).sortBy(bucket)
        writer.saveAsTable(f"`{database}`.{table}")
        return self.read_part(table, release, build, schema)

    def read_part(
        self, table: str, release: str, build: str, schema: StructType | None = None
    ) -> DataFrame:
        df = self.spark.table(f"`{self.database(release, build)}`.{table}")
        return df.select(*schema.names) if schema else df

    def add_release(
        self,
        release: str,
        context: str,
        build: str,
        earlier: Sequence[tuple[str, str]] = (),
    ) -> None:
        """List a build of a release; called once all its tables are stored."""
        listing = Listing(build, context, tuple(earlier))
        row = self.spark.range(1).select(
            F.lit(context).alias("context"), F.lit(listing.earlier_json()).alias("earlier")
        )
        self.write(LISTING, release, build, row)
        self.spark.sql(
            f"CREATE DATABASE IF NOT EXISTS `{release}` LOCATION '{self.location}/{release}'"
        )
        self.spark.sql(f"ALTER DATABASE `{release}` SET DBPROPERTIES ('{BUILD_PROPERTY}' = '{build}')")
        for found in self.spark.sql(f"SHOW TABLES IN `{self.database(release, build)}`").collect():
            full = FULL_TABLES.get(found.tableName)
            parts, columns = (earlier, ", ".join(full.names)) if full else ((), "*")
            query = " UNION ALL ".join(
                f"SELECT {columns} FROM `{self.database(r, b)}`.{found.tableName}"
                for r, b in (*parts, (release, build))
            )
            self.spark.sql(f"CREATE OR REPLACE VIEW `{release}`.{found.tableName} AS {query}")

    def withdraw(self, release: str) -> None:
        """Take a release off the list; its builds stay."""
        if self.has(release):
            self.spark.sql(f"ALTER DATABASE `{release}` SET DBPROPERTIES ('{BUILD_PROPERTY}' = '')")

    def listing(self, release: str) -> Listing | None:
        if not self.spark.catalog.databaseExists(f"`{release}`"):
            return None
        build = self._listed_build(release)
        if build is None:
            return None
        row = self.read_part(LISTING, release, build).first()
        return Listing.of(build, row.context, row.earlier)

    def _listed_build(self, release: str) -> str | None:
        rows = self.spark.sql(f"DESCRIBE DATABASE EXTENDED `{release}`").collect()
        shown = " ".join(row.info_value for row in rows if row.info_name == "Properties")
        found = re.search(rf"{re.escape(BUILD_PROPERTY)},([0-9a-f]+)", shown)
        return found and found[1]

    def _databases(self) -> list[str]:
        return [row.namespace for row in self.spark.sql("SHOW DATABASES").collect()]

    def releases(self, pattern: str | None = RELEASE_NAME) -> DataFrame:
        """Names of complete releases; the catalog keeps them in lower case."""
        complete = [(name,) for name in self._databases() if self._listed_build(name)]
        return matching_releases(self.spark.createDataFrame(complete, "release string"), pattern)

    def prune(self, release: str) -> list[str]:
        """Remove the builds of a release that no listed release consists of.

        Call it when nobody reads them or writes one. Returns the builds removed.
        """
        needed = set()
        names = self._databases()
        for name in names:
            listing = self.listing(name)
            if listing:
                parts = ((name, listing.build), *listing.earlier)
                needed |= {self.database(r, b).lower() for r, b in parts}
        prefix = self.database(release, "").lower()
        gone = [n for n in names if n.startswith(prefix) and n not in needed]
        for name in gone:
            self.spark.sql(f"DROP DATABASE `{name}` CASCADE")
        return sorted(name.removeprefix(prefix) for name in gone)
