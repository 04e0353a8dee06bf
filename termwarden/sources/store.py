"""Releases kept as Parquet, and the list of those that are complete.

Layout below the root:

    <table>/release=<name>/build=<id>/effectiveTime=<date>/   full tables
    <table>/release=<name>/build=<id>/active=<0|1>/           snapshots
    <table>/release=<name>/build=<id>/                        other derived tables
    releases/release=<name>/                                  which build is listed

Checks on what a release published touch one date of a full table, and most checks on
snapshots want either active or inactive rows, so both are pruned by partition.

A build never writes where another one does. A release is listed by one more small file
that names its build and its context, which either is there or is not: readers that opened
the build before go on with it, and those that open the release afterwards get the new one.
Builds that nobody needs any more are removed by `prune`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termwarden.schemas import FULL_TABLES

# Fixed value: how names of release databases look; not anchored at either end.
RELEASE_NAME = r"x?(_beta_)?snomed_.*full_"

#: How tables are written. Identifiers and terms are a quarter smaller with `zstd` than with the
#: default; the second version of the format stores differences of identifiers, which halves them.
WRITING = {"compression": "zstd", "parquet.writer.version": "v2"}

REGISTRY_SCHEMA = StructType(
    [
        StructField("number", LongType()),
        StructField("build", StringType()),
        StructField("context", StringType()),
        StructField("earlier", StringType()),
        StructField("release", StringType()),
    ]
)


@dataclass(frozen=True)
class Listing:
    """The build of a release that readers get.

    `earlier` names the builds, oldest first, whose full tables come before this one's own
    rows: a release that was added to another one holds only what is new.
    """

    build: str
    context: str
    earlier: tuple[tuple[str, str], ...] = ()

    def earlier_json(self) -> str:
        return json.dumps(self.earlier)

    @staticmethod
    def of(build: str, context: str, earlier: str | None) -> Listing:
        return Listing(build, context, tuple((r, b) for r, b in json.loads(earlier or "[]")))


class Store:
    """What the stores share: reading a release through its listing."""

    spark: SparkSession

    @staticmethod
    def new_build() -> str:
        return uuid.uuid4().hex

    def listing(self, release: str) -> Listing | None:
        raise NotImplementedError

    def read_part(
        self, table: str, release: str, build: str, schema: StructType | None = None
    ) -> DataFrame:
        raise NotImplementedError

    def read(
        self,
        table: str,
        release: str,
        schema: StructType | None = None,
        listing: Listing | None = None,
    ) -> DataFrame:
        """A table of a listed release, or of the build that `listing` names."""
        listing = listing or self.listing(release)
        if listing is None:
            raise KeyError(f"no such release: {release}")
        # What else is stored with the rows of a full table is no column of it.
        schema = schema or FULL_TABLES.get(table)
        earlier = listing.earlier if table in FULL_TABLES else ()
        parts = [self.read_part(table, r, b, schema) for r, b in (*earlier, (release, listing.build))]
        return reduce(DataFrame.unionByName, parts)

    def has(self, release: str) -> bool:
        """Whether a release is complete."""
        return self.listing(release) is not None

    def context(self, release: str) -> str | None:
        """The context a complete release was built with, as JSON."""
        listing = self.listing(release)
        return listing and listing.context


class ReleaseStore(Store):
    """Tables of one or more releases below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str, release: str, build: str) -> str:
        return f"{self.root}/{table}/release={release}/build={build}"

    def write(
        self,
        table: str,
        release: str,
        build: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        gather: bool = False,
    ) -> DataFrame:
        """Store a table of a build and return it as stored.

        A task sorts its rows by the partition columns and writes a file per value it has, one
        after the other. `gather` is for columns of so many values that files would be too
        many: rows are brought together by value first, in a shuffle of all of them. The
        rebalance splits values that hold many rows.
        """
        schema = df.schema
        if gather:
            df = df.hint("rebalance", *partition_by)
        writer = df.write.mode("overwrite").options(**WRITING)
        writer.partitionBy(*partition_by).parquet(self.path(table, release, build))
        return self.read_part(table, release, build, schema)

    def read_part(
        self, table: str, release: str, build: str, schema: StructType | None = None
    ) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        df = reader.parquet(self.path(table, release, build))
        return df.select(*schema.names) if schema else df

    def add_release(
        self,
        release: str,
        context: str,
        build: str = "",
        earlier: Sequence[tuple[str, str]] = (),
    ) -> None:
        """List a build of a release; called once all its tables are stored."""
        self._list(release, Listing(build, context, tuple(earlier)))

    def withdraw(self, release: str) -> None:
        """Take a release off the list; its builds stay."""
        if self.has(release):
            self._list(release, None)

    def _list(self, release: str, listing: Listing | None) -> None:
        rows = self._registry().where(F.col("release") == release)
        number = (rows.agg(F.max("number")).first()[0] or 0) + 1
        values = (number, *(listing and (listing.build, listing.context, listing.earlier_json()) or (None,) * 3))
        columns = [
            F.lit(value).cast(field.dataType).alias(field.name)
            for value, field in zip(values, REGISTRY_SCHEMA, strict=False)
        ]
        # One file, moved into place when it is written.
        row = self.spark.range(1).coalesce(1).select(*columns)
        row.write.mode("append").parquet(f"{self.root}/releases/release={release}")

    def _registry(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.root}/releases")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def _listed(self) -> DataFrame:
        """The last listing of every release that was not withdrawn since."""
        last = F.max(F.struct("number", "build", "context", "earlier")).alias("last")
        rows = self._registry().groupBy("release").agg(last)
        return rows.select("release", "last.*").where("context IS NOT NULL")

    def listing(self, release: str) -> Listing | None:
        row = self._listed().where(F.col("release") == release).first()
        return row and Listing.of(row.build, row.context, row.earlier)

    def releases(self, pattern: str | None = RELEASE_NAME) -> DataFrame:
        """Names of complete releases."""
        return matching_releases(self._listed().select("release"), pattern)

    def prune(self, release: str) -> list[str]:
        """Remove the builds of a release that no listed release consists of.

        Call it when nobody reads them or writes one. Returns the builds removed.
        """
        needed = set()
        for row in self._listed().collect():
            listing = Listing.of(row.build, row.context, row.earlier)
            needed |= {(row.release, listing.build), *listing.earlier}
        gone = set()
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = jvm_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.globStatus(jvm_path(f"{self.root}/*/release={release}/build=*")) or []:
            build = status.getPath().getName().partition("=")[2]
            if (release, build) not in needed:
                files.delete(status.getPath(), True)
                gone.add(build)
        return sorted(gone)


def matching_releases(names: DataFrame, pattern: str | None = RELEASE_NAME) -> DataFrame:
    """Rows of `names` whose `release` contains a match of the pattern."""
    return names.where(F.col("release").rlike(pattern)) if pattern else names
