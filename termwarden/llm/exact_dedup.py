"""Exact deduplication against a persistent index of digests.

The index is a table of `(digest, keep_id)`, bucketed and sorted by digest, in the shared
storage. New documents are reduced to one row per digest, anti-joined with the index
bucket by bucket (a sort-merge join that does not shuffle the index) and what is new is
appended, so the index never holds a digest twice. Every document then learns from the
index which id stays for its text.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal new
texts the row with the largest id stays; a null id is below all others. A text that the
index knows already is dropped whatever its id, unless it is the very row that stayed
(so an interrupted run can be repeated). Rows equal in id and text are one document: one
of them stays. An empty table gives an empty result and leaves the index alone.

The number of buckets is kept beside the data and taken from there: opened with another one,
Spark would read part of the files only. Batches that run at the same time meet the index one
after the other: who joins it with new digests and appends them holds its lock.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.llm.common import ascii_lower, work_folder
from termwarden.operators.skew import repeat_rows
from termwarden.sources.scratch import WorkFolder


#: Buckets of an index for which none are given.
BUCKETS = 64
#: Seconds that a batch waits for another one to append its digests.
PATIENCE = 3600

_own_locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


class DigestIndex:
    """The index at a path of the shared storage, created when first used.

    The number of buckets is fixed when the index is created; choose it for the size the
    index will have, some hundred megabytes a bucket. An index that exists is opened with
    its own number, and asking for another one is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.table = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self.buckets = self._bucket_count(buckets)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/digests'"
        )

    def _files(self, name: str):
        """The path of a file beside the data, and the storage it is in."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket_count(self, asked: int | None) -> int:
        """The number of buckets that a folder beside the data is named after."""
        with self.locked():
            pattern, files = self._files("buckets-*")
            found = [status.getPath().getName() for status in files.globStatus(pattern) or []]
            if not found:
                path, files = self._files(f"buckets-{asked or BUCKETS}")
                files.mkdirs(path)
                return asked or BUCKETS
        there = int(found[0].partition("-")[2])
        if len(found) > 1 or asked not in (None, there):
            raise ValueError(f"the index at {self.path} has {there} buckets, not {asked}")
        return there

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Alone with the index, among the threads of this driver and among drivers."""
        with _own_locks[self.path]:
            path, files = self._files("lock")
            files.mkdirs(path.getParent())
            until = time.monotonic() + PATIENCE
            while not self._created(path, files):
                if time.monotonic() > until:
                    raise TimeoutError(f"remove {path} if the batch that made it is gone")
                time.sleep(0.2)
            try:
                yield
            finally:
                files.delete(path, False)

    def _created(self, path, files) -> bool:
        """Whether the lock was made now; it is not if it was there."""
        if files.getScheme() == "file":
            try:
                os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            files.create(path, False).close()
        except Exception as error:  # noqa: BLE001  storages differ in what they raise
            if files.exists(path):
                return False
            raise error
        return True

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def beside(self, groups: DataFrame) -> DataFrame:
        """Rows with one digest each, dealt as the index is, so that it is not shuffled."""
        return groups.repartition(self.buckets, "digest")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows whose digest is not in the index.

        An anti join written as an outer one: Spark would move the former below the
        dealing, and then shuffle the index.
        """
        marked = self.read().select("digest", F.lit(True).alias("_known"))
        return self.beside(groups).join(marked, "digest", "left").where("_known IS NULL").drop("_known")

    def add(self, groups: DataFrame, work: WorkFolder) -> None:
        """Add those of `(digest, keep_id)` rows, one per digest, that the index lacks.

        What another batch has added meanwhile is seen, as both hold the lock in turn.
        """
        with self.locked():
            self.spark.catalog.refreshTable(self.table)
            self._append(work.write("new", self.unknown(groups).select("digest", "keep_id")))

    def _append(self, new: DataFrame) -> None:
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", f"{self.path}/digests")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)


def deduplicated(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)`, one row per row of `docs`.

    `group_size` counts the rows of `docs` with that text. The index is extended.
    """
    work = work_folder(docs)
    digest = F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    # Copies are counted per digest and id on the map side, so no group of copies is ever
    # in one place.
    copies = work.write(
        "copies",
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("_copies")),
    )
    groups = work.write(
        "groups",
        copies.groupBy("digest").agg(
            F.max("doc_id").alias("_largest"), F.sum("_copies").alias("group_size")
        ),
    )
    index.add(groups.select("digest", F.col("_largest").alias("keep_id")), work)
    known = work.write(
        "known",
        index.beside(groups)
        .join(index.read(), "digest")
        .select("digest", "keep_id", "group_size"),
    )
    first = F.col("_copy") == 1
    return (
        repeat_rows(copies.join(known, "digest"), "_copies", "_copy")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
