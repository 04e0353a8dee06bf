from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from termwarden.session import SETTINGS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    builder = SparkSession.builder.master("local[4]").appName("tests")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def release(spark):
    """The release derived from the smallest scale folder."""
    from harness.registered import release_of

    return release_of(spark, SMALL)
