"""Intermediate results in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

#: Folders of local sessions that name none, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: the one the session names.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="termwarden-")
    return _local[application]


class WorkFolder:
    """A fresh sub-folder for the steps of one derivation.

    Steps are written as Parquet and read back, which cuts their lineage and tells the
    planner how large they are. Nothing is kept on a machine of its own. The folder goes when
    it is deleted, or else when the session's driver ends. `writing` are options of its files.
    """

    def __init__(
        self,
        spark: SparkSession,
        parent: str | None = None,
        writing: Mapping[str, str] | None = None,
    ) -> None:
        self.spark = spark
        self.writing = writing or {}
        self.path = f"{parent or shared_folder(spark)}/work-{uuid.uuid4().hex}"
        path, files = self._located()
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _located(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def delete(self) -> None:
        """Remove the folder; what was read from it must have been stored elsewhere."""
        path, files = self._located()
        files.delete(path, True)
        files.cancelDeleteOnExit(path)

    def write(
        self, name: str, df: DataFrame, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        path = f"{self.path}/{name}"
        schema = df.schema
        df.write.options(**self.writing).partitionBy(*partition_by).parquet(path)
        stored = self.spark.read.schema(schema).parquet(path)
        return stored.select(*schema.names)
