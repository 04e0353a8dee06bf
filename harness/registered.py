"""The registered queries: every operator and check on tables of a scale folder.

Checks read a release that is built once per session and folder, as a loaded database
would be: tables are stored on first use. Operators are run on its full tables, or on
packages written from the raw rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harness import fixtures
from harness.fixture_packages import FixturePackages
from termwarden.context import CORE_MODULE
from termwarden.functions.dates import previous_base_release_column, release_date_column
from termwarden.operators import closure, hierarchies, names, refsets, versions
from termwarden.plans import report
from termwarden.plans.catalogue import CATALOGUE, STATISTICS, Catalogue, sql_check
from termwarden.plans.checks import descriptions
from termwarden.plans.release import Release
from termwarden.schemas import FULL_TABLES, SNAPSHOT_PACKAGE_TABLES
from termwarden.session import configure, stored_tasks, widen_shuffles
from termwarden.sources.packages import load_full, load_snapshot, package_columns
from termwarden.sources.catalog import CatalogStore
from termwarden.sources.scratch import WorkFolder
from termwarden.sources.store import ReleaseStore, matching_releases

Query = Callable[[SparkSession, str], DataFrame]

#: Values the nested checks are asked for.
PARAMETERS = {
    "concept-refset-inactive": 20001000052105,
    "concept-duplicate": "red widget (economy)",
    "multi-desc-lang-refset": 1000052105,
}

#: A release is cut here into one that is stored and what another one adds to it.
SPLIT = 20001130
BEFORE, AFTER = "snomed_full_SE1000052_20001130", "snomed_full_SE1000052_20011130"
#: How terms are compared in the collated form of the lookups.
COLLATION = "UTF8_LCASE"

#: Stored under other context than the fixtures', to see that it is kept.
OTHER_MODULE = CORE_MODULE
#: A hot key in the sliced form of the checks has more rows than this.
SLICE = 20

#: Buckets of a small release in a catalog; a larger one has as many as it is dealt to tasks.
BUCKETS = 4

_releases: dict[tuple[str, str], Release] = {}
_packages: dict[tuple[str, str], FixturePackages] = {}
_extended: dict[str, Release] = {}
_buckets: dict[str, int] = {}


def release_of(spark: SparkSession, sf_dir: str) -> Release:
    """The release of a folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _releases:
        size = fixtures.input_bytes(spark, sf_dir)
        widen_shuffles(spark, size)
        _releases[key] = fixtures.release(spark, sf_dir)
        _buckets[_releases[key].own_folder().path] = max(BUCKETS, stored_tasks(size))
    return _releases[key]


def packages_of(spark: SparkSession, sf_dir: str) -> FixturePackages:
    """The packages of a folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _packages:
        configure(spark)
        widen_shuffles(spark, fixtures.input_bytes(spark, sf_dir))
        _packages[key] = FixturePackages(spark, sf_dir)
    return _packages[key]


def queries() -> dict[str, Query]:
    registered: dict[str, Query] = {}
    for table in FULL_TABLES:
        registered[f"load_full_{table}"] = partial(_load_full, table)
        if table != "owlrefsets":
            registered[f"snapshot_{table}"] = _on_release(
                lambda r, table=table: versions.snapshot(r.table(table))
            )
    for table in SNAPSHOT_PACKAGE_TABLES:
        registered[f"load_snapshot_{table}"] = partial(_load_snapshot, table)
    registered["keyed_descriptions"] = lambda spark, sf_dir: fixtures.full_table(
        spark, sf_dir, "descriptions"
    )
    registered["release_packages"] = _release_packages
    registered["package_concepts_named"] = _package_concepts
    registered |= {name: _on_release(run) for name, run in _OPERATORS.items()}
    for check in CATALOGUE:
        registered[check.id.replace("-", "_")] = _on_release(
            lambda r, check=check: CATALOGUE.run(check.id, r, PARAMETERS.get(check.id))
        )
    for check_id in SLICED:
        registered[f"sliced_{check_id.replace('-', '_')}"] = _on_release(
            lambda r, check_id=check_id: CATALOGUE.run(check_id, _sliced(r), PARAMETERS.get(check_id))
        )
    for table in FULL_TABLES:
        if table != "owlrefsets":
            registered[f"extended_snapshot_{table}"] = _on_release(
                lambda r, table=table: extended_of(r).table(f"{table}_snap")
            )
    for check in STATISTICS:
        registered[f"stat_{check.id.replace('-', '_')}"] = _on_release(check.build)
    return registered


#: Checks that join row by row on keys of which one value may hold many rows.
SLICED = (
    "inactive-concepts-in-refsets",
    "concept-refset-inactive",
    "concept-duplicate",
    "active-langrefset-en-descriptions",
    "active-langrefset-multiple-descriptions",
    "multi-desc-lang-refset",
)


def _sliced(release: Release) -> Release:
    """The release with so low a bound on the rows of a task that many keys are cut."""
    return release.cut_at(SLICE)


def _stored(release: Release, store, name: str, once: bool = True, **overrides) -> Release:
    """The release's full tables under another name and context.

    Those copied more than `once` are stored first, so that they are derived once only.
    """
    read = release.marked if once else release.table
    full = {table: partial(read, table) for table in FULL_TABLES}
    context = replace(release.context, **overrides)
    return Release(release.spark, name, full, context, store, dated=True)


def _store_of(release: Release, kind: str) -> ReleaseStore | CatalogStore:
    """A store of its own, in files or in the catalog."""
    folder = WorkFolder(release.spark).path
    if kind == "files":
        return ReleaseStore(release.spark, folder)
    return CatalogStore(release.spark, folder, _buckets[release.own_folder().path])


def _mark(store: ReleaseStore | CatalogStore) -> str:
    """What names in the catalog, which stores share, begin with to be this store's own."""
    folder = store.root if isinstance(store, ReleaseStore) else store.location
    return folder.rpartition("-")[2]


def extended_of(release: Release) -> Release:
    """The fixture's release, made by adding its last dates to a stored one without them.

    Tables of both are stored when they are asked for.
    """
    key = release.own_folder().path
    if key not in _extended:
        store = ReleaseStore(release.spark, WorkFolder(release.spark).path)
        time = F.col("effectiveTime")
        # Each row is copied into one of the two, so the fixture's own copy is not stored.
        part = lambda rows: {
            t: lambda t=t: release.source(t).where(rows) for t in FULL_TABLES
        }
        dates = {"release_date": SPLIT, "base_release_date": 20000131}
        context = replace(release.context, **dates)
        before = Release(release.spark, BEFORE, part(time <= SPLIT), context, store, dated=True)
        # What is loaded again with the new rows, as from full files, is there already.
        _extended[key] = Release.added(before, AFTER, part(time >= SPLIT))
    return _extended[key]


def _reopened_extension(release: Release) -> DataFrame:
    """Rows by date of a table that is stored in the parts of two builds."""
    extended = extended_of(release).build()
    opened = Release.open(extended.store, extended.name)
    rows = opened.table("descriptions").groupBy("effectiveTime")
    return rows.agg(F.count(F.lit(1)).alias("rows"))


def _read_while_rebuilt(release: Release, kind: str) -> DataFrame:
    """Active concepts that readers see who opened a release before and after a rebuild."""
    store = _store_of(release, kind)
    name = f"a{_mark(store)}_snomed_full_{SPLIT}"
    rows = lambda r, reader: r.table("concepts_snap").where("active = 1").agg(
        F.lit(reader).alias("reader"), F.count(F.lit(1)).alias("concepts")
    )
    first = _stored(release, store, name)
    first._full["concepts"] = lambda: release.table("concepts").where(
        F.col("effectiveTime") <= SPLIT
    )
    first.build()
    early = Release.open(store, name)
    # What both hold is copied from the first, so that it is derived and stored once before.
    second = _stored(early, store, name)
    second._full["concepts"] = partial(release.marked, "concepts")
    second.build()
    late = Release.open(store, name)
    return rows(early, "before").unionByName(rows(late, "after"))


def _collated(release: Release) -> Release:
    """The sliced release with terms compared without regard to case."""
    collated = _sliced(release)
    collated.context = replace(release.context, collation=COLLATION)
    return collated


def _collated_lookup(release: Release) -> DataFrame:
    """Concepts of terms that are asked for in capitals, as drill-downs ask."""
    asked = release.table("concepts_snap2").where("id % 3 = 0")
    terms = release.table("descriptions_snap").join(
        asked.select(F.col("id").alias("conceptId")), "conceptId", "left_semi"
    )
    params = terms.select(F.upper("term").alias("param")).distinct()
    return descriptions.concepts_with_term(_collated(release), params)


def _reopened_changes(release: Release) -> DataFrame:
    """Changes of another module's concepts, from a release that was stored and opened."""
    store = ReleaseStore(release.spark, WorkFolder(release.spark).path)
    _stored(release, store, release.name, extension_module=OTHER_MODULE).build()
    return CATALOGUE.run("changed-concepts", Release.open(store, release.name))


def _listed_releases(release: Release, kind: str) -> DataFrame:
    """Releases of a store in which of two one is complete, with their concepts."""
    store = _store_of(release, kind)
    mark = _mark(store)
    complete, partial_name = f"a{mark}_snomed_full_one", f"a{mark}_snomed_full_two"
    _stored(release, store, complete).build()
    _stored(release, store, partial_name).table("concepts")
    listed = store.releases().where(F.col("release").startswith(f"a{mark}"))
    parts = [
        store.read("concepts", row.release).agg(
            F.lit(row.release == complete).alias("complete"), F.count(F.lit(1)).alias("concepts")
        )
        for row in listed.collect()
    ]
    return reduce(DataFrame.unionByName, parts)


def _run_all(release: Release) -> DataFrame:
    """Rows of every listed check, written to a folder and counted as read back."""
    folder = release.own_folder().path + "/all"
    counts = report.run_all(release, folder)
    read = [
        release.spark.read.parquet(f"{folder}/{check.id}")
        .agg(F.count(F.lit(1)).alias("stored"))
        .select(F.lit(check.id).alias("check_id"), "stored")
        for check in CATALOGUE.listed()
    ]
    stored = reduce(DataFrame.unionByName, read)
    return counts.join(stored, "check_id").select("check_id", "rows", "stored")


def _own_checks() -> Catalogue:
    return Catalogue(
        [
            sql_check(
                "published",
                "Concepts by module",
                "SELECT moduleId, count(*) AS ct FROM {concepts} "
                "WHERE effectiveTime = :release GROUP BY moduleId",
            ),
            sql_check(
                "terms-of",
                "Terms of a concept before the release",
                "SELECT conceptId AS param, id, term FROM {descriptions} "
                "WHERE effectiveTime < :release",
                nested=True,
                param_type=int,
            ),
        ]
    )


def _on_release(run: Callable[[Release], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(release_of(spark, sf_dir))


def _load_full(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = packages_of(spark, sf_dir).provide(table, "Full")
    return load_full(spark, table, packages.base, packages.extension)


def _load_snapshot(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = packages_of(spark, sf_dir).provide(table, "Snapshot")
    return load_snapshot(spark, table, packages.base, packages.extension)


def _release_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages the concept rows come from, as their file paths tell."""
    packages = packages_of(spark, sf_dir).provide("concepts", "Full")
    paths = [
        path for p in (packages.base, packages.extension) for path in p.files("concepts", "Full")
    ]
    rows = spark.read.schema(FULL_TABLES["concepts"]).option("sep", "\t").option("header", True)
    columns = package_columns(F.col("_metadata.file_path"))
    return (
        rows.csv(paths)
        .select(*(column.alias(name) for name, column in columns.items()))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("ct"))
    )


def _package_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of the snapshot packages with names, tags and descendant counts."""
    concepts, descriptions, relationships = (
        _load_snapshot(table, spark, sf_dir)
        for table in ("concepts", "descriptions", "relationships")
    )
    release = release_of(spark, sf_dir)
    pairs = closure.transitive_closure(
        concepts, relationships, release.context, release.work()
    )
    named = names.with_package_names(concepts, descriptions, release.context)
    return closure.with_descendants(named, pairs)


def _release_dates(release: Release) -> DataFrame:
    """Release names made of the dates in the concepts, and what follows from them."""
    dates = release.table("concepts").select("effectiveTime").distinct()
    named = dates.select(
        F.concat(F.lit("snomed_full_SE1000052_"), "effectiveTime").alias("release")
    )
    date = release_date_column(F.col("release"))
    return named.select(
        "release",
        date.alias("releaseDate"),
        previous_base_release_column(date).alias("baseReleaseDate"),
    )


def _matching_releases(release: Release) -> DataFrame:
    """Which of several kinds of names are names of releases."""
    dates = release.table("concepts").select("effectiveTime").distinct()
    kind = F.expr("effectiveTime div 10000 % 4")
    prefix = (
        F.when(kind == 0, "snomed_full_")
        .when(kind == 1, "xsnomed_full_SE1000052_")
        .when(kind == 2, "x_beta_snomed_ext_full_")
        .otherwise("snomed_")
    )
    return matching_releases(dates.select(F.concat(prefix, "effectiveTime").alias("release")))


def _semantic_tags(release: Release) -> DataFrame:
    return release.table("concepts_snap2").groupBy("semtag").agg(F.count(F.lit(1)).alias("ct"))


def _closure_selves(release: Release) -> DataFrame:
    return closure.selves(release.table("concepts_snap"))


_OPERATORS: dict[str, Callable[[Release], DataFrame]] = {
    "reopened_changed_concepts": _reopened_changes,
    "listed_releases_files": lambda r: _listed_releases(r, "files"),
    "listed_releases_catalog": lambda r: _listed_releases(r, "catalog"),
    "run_all_checks": _run_all,
    "sql_check_published": lambda r: _own_checks().run("published", r),
    "sql_check_terms_of": lambda r: _own_checks().run("terms-of", r, 20001000052105),
    "extended_closure": lambda r: extended_of(r).table("transitiveclosure"),
    "extended_named_concepts": lambda r: extended_of(r).table("concepts_snap2"),
    "extended_language_terms": lambda r: extended_of(r).table("language_terms"),
    "extended_rows_reopened": _reopened_extension,
    "read_while_rebuilt_files": lambda r: _read_while_rebuilt(r, "files"),
    "read_while_rebuilt_catalog": lambda r: _read_while_rebuilt(r, "catalog"),
    "collated_concept_duplicate": lambda r: CATALOGUE.run(
        "concept-duplicate", _collated(r), PARAMETERS["concept-duplicate"].upper()
    ),
    "collated_concepts_with_terms": _collated_lookup,
    "term_index": lambda r: r.table("term_index"),
    "release_dates": _release_dates,
    "matching_releases": _matching_releases,
    "named_concepts": lambda r: names.with_names(
        r.table("concepts_snap"), r.table("descriptions_snap"), r.context
    ),
    "ambiguous_names": lambda r: names.ambiguous_names(
        r.table("descriptions_snap"), r.context
    ),
    "semantic_tags": _semantic_tags,
    "closure_selves": _closure_selves,
    "closure_edges": lambda r: closure.is_a_edges(r.table("relationships_snap"), r.context),
    "transitive_closure": lambda r: closure.transitive_closure(
        r.table("concepts_snap"), r.table("relationships_snap"), r.context, r.work()
    ),
    "descendant_counts": lambda r: closure.descendant_counts(r.table("transitiveclosure")),
    "top_concepts": lambda r: hierarchies.top_concepts(
        r.spark, r.table("relationships_snap"), r.context, r.work()
    ),
    "hierarchies": lambda r: hierarchies.hierarchies(
        r.spark,
        r.table("relationships_snap"),
        r.table("descriptions_snap"),
        r.table("languagerefsets_snap"),
        r.context,
        r.work(),
    ),
    "version_counts": lambda r: versions.extension_changes(
        r.table("concepts"), r.context.release_date, r.context.extension_module
    ),
    "refsets_in_use": lambda r: refsets.refsets_in_use(
        {
            "language": r.table("languagerefsets_snap"),
            "simple": r.table("simplerefsets_snap"),
        }
    ),
    "all_envelopes": report.all_envelopes,
    "check_counts": report.check_counts,
    "drill_inactive_concepts": lambda r: report.drill_down(r, "inactive-concepts-in-refsets"),
    "drill_duplicate_terms": lambda r: report.drill_down(r, "duplicate-descriptions"),
    "drill_repeated_members": lambda r: report.drill_down(
        r, "active-langrefset-multiple-descriptions"
    ),
}
