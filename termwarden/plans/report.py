"""Running many checks, and the shapes their results leave in."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termwarden.plans.catalogue import CATALOGUE, Catalogue, CheckSpec, Param
from termwarden.plans.checks.rowwise import sharing_scans
from termwarden.plans.release import Release


def envelope(
    rows: DataFrame, check_id: str, release: str, param: Param | None = None
) -> DataFrame:
    """Rows of any check in one shape, `(queryId, release, parameter, result)`.

    `result` is a row as JSON, with its nulls.
    """
    return rows.select(
        F.lit(check_id).alias("queryId"),
        F.lit(release).alias("release"),
        F.lit(None if param is None else str(param)).cast("string").alias("parameter"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("result"),
    )


def all_envelopes(release: Release, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """Rows of all checks that need no parameter, in one frame without an order."""
    release = release.unordered()
    return _union(
        envelope(check.build(release), check.id, release.name)
        for check in catalogue.listed()
    )


def check_counts(release: Release, catalogue: Catalogue = CATALOGUE) -> DataFrame:
    """Rows each listed check returns, `(check_id, description, rows)`."""
    release = release.unordered()
    return _union(
        check.build(release)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(check.id).alias("check_id"),
            F.lit(check.description).alias("description"),
            "rows",
        )
        for check in catalogue.listed()
    )


def run_all(
    release: Release,
    folder: str,
    catalogue: Catalogue = CATALOGUE,
    file_format: str = "parquet",
    parallel: int = 4,
) -> DataFrame:
    """Write every listed check to `folder/<check id>` and return `(check_id, rows)`.

    Rows are counted while they are written. Shared tables are stored before the checks
    start; some checks then run side by side, so that small ones do not leave a cluster
    idle. Checks that look at single descriptions share one scan of them.
    """
    release = sharing_scans(release.build())

    def write(check: CheckSpec) -> tuple[str, int]:
        seen = Observation()
        rows = check.build(release).observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.format(file_format).mode("overwrite").save(f"{folder}/{check.id}")
        return check.id, seen.get["rows"]

    with ThreadPoolExecutor(parallel) as pool:
        counts = list(pool.map(write, catalogue.listed()))
    return release.spark.createDataFrame(counts, "check_id string, rows long")


@dataclass(frozen=True)
class DrillDown:
    """A nested check that answers for the rows of another one."""

    parent: str
    column: str
    child: str


DRILL_DOWNS = (
    DrillDown("inactive-concepts-in-refsets", "id", "concept-refset-inactive"),
    DrillDown("duplicate-descriptions", "term", "concept-duplicate"),
    DrillDown(
        "active-langrefset-multiple-descriptions", "refsetId", "multi-desc-lang-refset"
    ),
)


def drill_down(
    release: Release, parent: str, catalogue: Catalogue = CATALOGUE
) -> DataFrame:
    """The nested check behind `parent` for all values its rows hold, in one job.

    The parent's distinct values are stored first: the nested relation is cut to them
    where that is cheapest, and the planner knows how many there are. The `param` column
    of the result tells them apart.
    """
    link = next((d for d in DRILL_DOWNS if d.parent == parent), None)
    if link is None:
        raise KeyError(f"nothing behind {parent}")

    def values() -> DataFrame:
        rows = catalogue.get(parent).build(release.unordered())
        return rows.select(F.col(link.column).alias("param")).distinct()

    return catalogue.get(link.child).build(release, release.kept(f"behind-{parent}", values))


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
