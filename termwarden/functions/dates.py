"""Release dates: `yyyymmdd` integers, which order like the dates they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An extension published on 31 May builds on the base release of 31
# July the year before, any other one on that of 31 January the same year.
SPRING_RELEASE = 531
SUMMER_BASE = 731
WINTER_BASE = 131


def release_date_of(name: str) -> int:
    """Date of a release: what follows the last underscore of its name."""
    return int(name.rpartition("_")[2])


def release_date_column(name: Column) -> Column:
    """`release_date_of` over a column of release names."""
    return F.element_at(F.split(name, "_"), -1).cast("int")


def previous_base_release(date: int) -> int:
    """Date of the base release an extension release of `date` builds on."""
    year, day = divmod(date, 10_000)
    if day == SPRING_RELEASE:
        return (year - 1) * 10_000 + SUMMER_BASE
    return year * 10_000 + WINTER_BASE


def previous_base_release_column(date: Column) -> Column:
    """`previous_base_release` over a column of dates."""
    year = F.floor(date / 10_000).cast("int")
    return (
        F.when(date % 10_000 == SPRING_RELEASE, (year - 1) * 10_000 + SUMMER_BASE)
        .otherwise(year * 10_000 + WINTER_BASE)
        .cast("int")
    )
