"""Hand-made release tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termwarden.context import (
    CORE_MODULE,
    EXTENSION_LANGUAGE_REFSET,
    EXTENSION_MODULE,
    FULLY_SPECIFIED_NAME,
    IS_A,
    PREFERRED,
    ROOT_CONCEPT,
    CheckContext,
)
from termwarden.plans.release import Release
from termwarden.schemas import FULL_TABLES

NAME = "snomed_full_SE1000052_20180531"
R = 20180531
SE, CORE = EXTENSION_MODULE, CORE_MODULE
ROOT, FSN, SYN = ROOT_CONCEPT, FULLY_SPECIFIED_NAME, 900000000000013009
PREF, LANGUAGE_REFSET = PREFERRED, EXTENSION_LANGUAGE_REFSET
IS = IS_A


def concept(id, time=R, active=1, module=SE, status=900000000000074008):
    return (id, time, active, module, status)


def description(id, concept, term, lang="sv", type=SYN, time=R, active=1, module=SE):
    return (id, time, active, module, concept, lang, type, term, 900000000000448009)


def is_a(id, source, destination, active=1, type=IS, time=R, module=SE):
    return (id, time, active, module, source, destination, 0, type, 1, 2)


def language(id, refset, component, active=1, acceptability=PREF, time=R, module=SE):
    return (id, time, active, module, refset, component, acceptability)


def simple(id, refset, component, active=1, time=R, module=SE):
    return (id, time, active, module, refset, component)


def frame(spark: SparkSession, table: str, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), FULL_TABLES[table])


def make_release(spark: SparkSession, rows_per_task=None, overrides=None, **tables) -> Release:
    """A release of the given rows; tables that are not given are empty."""
    full = {name: frame(spark, name, tables.get(name, ())) for name in FULL_TABLES}
    context = CheckContext.for_release(NAME, **(overrides or {}))
    options = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    return Release(spark, NAME, full, context, **options)


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]
