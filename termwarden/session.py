"""Session settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that matter at scale. Joins on keys that one value may dominate rely on
#: the adaptive skew split; joins against small stored tables on the size check that
#: `autoBroadcastJoinThreshold` makes against their files. Identifiers compress well, so
#: that check has to count files at several times their size. For the same reason a split of
#: a stored table may not be large: windows sort the rows of a split before they shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

#: Values that Spark has where nobody set one.
DEFAULTS = {
    "spark.sql.sources.fileCompressionFactor": "1.0",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "67108864b",
}

#: Input of one shuffle task.
BYTES_PER_TASK = 512 << 20

#: The same where the input is Parquet files of identifiers, tens of bytes of memory each.
STORED_BYTES_PER_TASK = 16 << 20
#: Partitions a shuffle starts with, before adaptive execution merges small ones.
FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def settings_for(input_bytes: int, cores: int, most_tasks: int | None = None) -> dict[str, str]:
    """Settings for a release of about that size, on that many cores.

    Shuffles start with enough partitions for the largest table; adaptive execution
    merges them where less data arrives. `most_tasks` bounds their number where a cluster
    cannot serve so many blocks; tasks are larger then.
    """
    tasks = max(cores, -(-input_bytes // BYTES_PER_TASK))
    return SETTINGS | {
        "spark.sql.shuffle.partitions": str(min(tasks, most_tasks or tasks)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    }


def stored_tasks(input_bytes: int) -> int:
    """Tasks that stored input of that size is to be dealt to, so that each sorts in memory."""
    return -(-input_bytes // STORED_BYTES_PER_TASK)


def widen_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles start with enough partitions for stored input of that size.

    Never with fewer than before; adaptive execution merges those it needs not.
    """
    now = spark.conf.get(FIRST_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    if stored_tasks(input_bytes) > int(now):
        spark.conf.set(FIRST_PARTITIONS, str(stored_tasks(input_bytes)))


def configure(spark: SparkSession, settings: dict[str, str] | None = None) -> None:
    """Set what the engine relies on and a running session lets be changed.

    Without `settings` only what the session has not set itself; pass `settings_for(...)`
    to size shuffles for a release.
    """
    for key, value in (settings or SETTINGS).items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            if settings or spark.conf.get(key, None) in (None, DEFAULTS.get(key)):
                spark.conf.set(key, value)


def local_session(app_name: str = "termwarden", cpus: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("TERMWARDEN_DRIVER_MEMORY", "8g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
