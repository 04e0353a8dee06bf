"""What plans look like once tables are too large to broadcast."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from harness import registered
from termwarden.operators import versions
from termwarden.plans.catalogue import CATALOGUE, STATISTICS
from termwarden.plans.release import TABLES
from termwarden.session import (
    FIRST_PARTITIONS,
    configure,
    settings_for,
    stored_tasks,
    widen_shuffles,
)
from termwarden.sources.store import ReleaseStore

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plan_of(spark):
    """Plans with a threshold that only the small stored tables stay below."""
    release = registered.release_of(spark, MEDIUM)
    for table in TABLES:
        release.table(table)
    spark.conf.set(THRESHOLD, "15000")

    def plan(check_id: str) -> str:
        catalogue = STATISTICS if check_id in {c.id for c in STATISTICS} else CATALOGUE
        shown = io.StringIO()
        df = catalogue.run(check_id, release, registered.PARAMETERS.get(check_id))
        with redirect_stdout(shown):
            df.explain()
        return shown.getvalue()

    yield plan
    spark.conf.unset(THRESHOLD)


ALL = [check.id for check in (*CATALOGUE, *STATISTICS)]


@pytest.mark.parametrize("check_id", ALL)
def test_no_check_compares_all_pairs_or_leaves_the_jvm(plan_of, check_id):
    plan = plan_of(check_id)
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("check_id", ALL)
def test_only_totals_meet_in_one_partition(plan_of, check_id):
    """What is exchanged to a single partition has been combined before."""
    lines = plan_of(check_id).splitlines()
    for above, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in above:
            assert "partial_" in below


@pytest.mark.parametrize(
    ("check_id", "shuffles"),
    [
        ("funky-chars", 0),
        ("descriptions-spaces", 0),
        ("se-module-with-non-se-ids", 0),
        ("changed-concepts", 0),
        ("inactivated-descriptions", 0),
        # What a date published, and the stored number of terms; not the history.
        ("new-synonyms", 2),
        ("promoted-concepts", 3),
        ("active-langrefset-inactive-descriptions", 2),
        # Twice what the usual rows need: the second half is for hot values.
        ("active-langrefset-en-descriptions", 4),
        ("non-translated", 4),
    ],
)
def test_number_of_shuffles(plan_of, check_id, shuffles):
    assert plan_of(check_id).count("Exchange hashpartitioning") == shuffles


def test_small_stored_tables_are_broadcast(plan_of):
    assert plan_of("non-translated").count("BroadcastExchange") == 1


def test_scans_read_what_is_needed(plan_of):
    plan = plan_of("inactivated-descriptions")
    assert re.search(r"PartitionFilters: \[isnotnull\(effectiveTime\S*\), \(effectiveTime", plan)
    assert "ReadSchema: struct<active:int,moduleId:bigint,languageCode:string>" in plan
    assert "term:string" not in plan_of("non-translated")


def test_shuffle_sizes_follow_the_data():
    partitions = "spark.sql.shuffle.partitions"
    assert settings_for(1 << 30, cores=64)[partitions] == "64"
    assert settings_for(1 << 40, cores=64)[partitions] == "2048"
    assert settings_for(100 << 40, cores=8000)[partitions] == "204800"
    assert settings_for(100 << 40, 8000, most_tasks=40_000)[partitions] == "40000"


@pytest.fixture
def checked_plan(spark, plan_of):
    """Plans under Spark's own size check."""
    spark.conf.unset(THRESHOLD)
    yield plan_of
    spark.conf.set(THRESHOLD, "15000")


def test_histories_are_cut_before_they_are_shuffled(checked_plan):
    """Candidates of the release are broadcast; nothing else of the history is exchanged."""
    for check_id in ("promoted-concepts", "descriptions"):
        lines = checked_plan(check_id).splitlines()
        for above, below in zip(lines, lines[1:]):
            if "Exchange hashpartitioning(id" in above:
                assert "partial_" in below or "HashAggregate" in below or "keys=[id" in below, above


def test_all_versions_of_terms_are_not_counted_again(checked_plan):
    """Only the release's date of the history is read, and nothing else of it exchanged."""
    plan = checked_plan("new-synonyms")
    assert plan.count("FileScan") == 2 and "(effectiveTime" in plan
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:]):
        assert "Exchange hashpartitioning" not in above or "partial_" in below, above


@pytest.mark.parametrize("check_id", ["new-concepts", "non-translated", "new-concepts-by-term"])
def test_hierarchies_are_counted_without_the_closure(plan_of, check_id):
    assert "transitiveclosure" not in plan_of(check_id)


def test_marks_are_counted_without_a_shuffle_of_the_refset(spark, checked_plan):
    from termwarden.operators.names import preferred_terms

    release = registered.release_of(spark, MEDIUM)
    few = release.table("descriptions_snap").where("conceptId = 20001000052105")
    few = release.work().write("few", few)
    terms = preferred_terms(few, release.table("languagerefsets_snap"), release.context, True)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:]):
        assert "Exchange hashpartitioning" not in above or "partial_count" in below


def test_envelopes_keep_no_order(spark):
    from termwarden.plans import report

    release = registered.release_of(spark, MEDIUM)
    plan = report.all_envelopes(release)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_a_hot_refset_is_split_without_broadcasts(spark, plan_of):
    release = registered._sliced(registered.release_of(spark, MEDIUM))
    assert not release.table("hot_language_refsets").isEmpty()
    spark.conf.set(THRESHOLD, "-1")
    try:
        for check_id in ("active-langrefset-multiple-descriptions", "multi-desc-lang-refset"):
            df = CATALOGUE.run(check_id, release, registered.PARAMETERS.get(check_id))
            assert "_slice" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(THRESHOLD, "15000")


def test_without_hot_values_only_the_usual_rows_are_joined(spark):
    release = registered.release_of(spark, MEDIUM)
    assert release.table("hot_simple_refsets").isEmpty()
    df = CATALOGUE.run("inactive-concepts-in-refsets", release)
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    final = execution.executedPlan().toString().partition("Initial Plan")[0]
    assert "_slice" not in final and "Union" not in final


def test_sliced_and_extended_releases_derive_what_is_asked(spark):
    release = registered.fixtures.release(spark, MEDIUM)
    registered._sliced(release).table("simplerefsets_snap")
    assert set(release._tables) == {"simplerefsets", "simplerefsets_snap"}
    extended = registered.extended_of(release)
    extended.table("refsetdescriptors_snap")
    assert set(extended._tables) == {"refsetdescriptors", "refsetdescriptors_snap"}
    assert set(extended._before._tables) == set(extended._tables)


def test_extended_releases_do_not_store_what_they_copy(spark):
    release = registered.fixtures.release(spark, MEDIUM)
    extended = registered.extended_of(release)
    rows = extended.table("owlrefsets")
    assert not release._tables
    assert rows.exceptAll(release.table("owlrefsets")).isEmpty()
    assert release.table("owlrefsets").exceptAll(rows).isEmpty()


def test_rebuilt_releases_store_tables_once_a_build(spark):
    release = registered.fixtures.release(spark, "/root/testdata/sf0.001")
    counted = {r.reader: r.concepts for r in registered._read_while_rebuilt(release, "files").collect()}
    active = release.table("concepts_snap").where("active = 1").count()
    assert counted["after"] == active and set(counted) == {"before", "after"}
    # Relationships are made of all concepts.
    assert set(release._tables) == {"concepts", "concepts_snap"}


def test_tasks_of_shuffles_are_small_unless_the_session_says_otherwise(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    try:
        spark.conf.unset(size)
        configure(spark)
        assert spark.conf.get(size) == "16m"
        spark.conf.set(size, "8m")
        configure(spark)
        assert spark.conf.get(size) == "8m"
    finally:
        spark.conf.unset(size)
        if before:
            spark.conf.set(size, before)


def test_stored_input_is_dealt_to_tasks_by_its_size(spark):
    release = registered.release_of(spark, MEDIUM)
    assert registered._store_of(release, "catalog").buckets == 4
    key, before = release.own_folder().path, spark.conf.get(FIRST_PARTITIONS, None)
    small, registered._buckets[key] = registered._buckets[key], stored_tasks(6 << 30)
    try:
        assert registered._store_of(release, "catalog").buckets == 384
        widen_shuffles(spark, 6 << 30)
        widen_shuffles(spark, 1 << 20)
        assert spark.conf.get(FIRST_PARTITIONS) == "384"
    finally:
        registered._buckets[key] = small
        spark.conf.unset(FIRST_PARTITIONS)
        if before:
            spark.conf.set(FIRST_PARTITIONS, before)


def test_rows_stored_by_date_are_not_shuffled_to_be_stored_again(spark, monkeypatch, tmp_path):
    release, gathered = registered.fixtures.release(spark, MEDIUM), {}
    store = ReleaseStore(spark, str(tmp_path / "dated"))
    write = store.write

    def seen(table, *args, gather=False, **options):
        gathered[table] = gather
        return write(table, *args, gather=gather, **options)

    monkeypatch.setattr(store, "write", seen)
    copied = registered._stored(release, store, release.name).table("concepts")
    assert copied.exceptAll(release.table("concepts")).isEmpty()
    assert copied.count() == release.table("concepts").count()
    assert gathered == {"concepts": False}


def test_full_tables_are_not_shuffled_by_date_to_be_stored(spark, monkeypatch, tmp_path):
    release, gathered = registered.fixtures.release(spark, MEDIUM), {}
    write = release.store.write

    def seen(table, *args, gather=False, **options):
        gathered[table] = gather
        return write(table, *args, gather=gather, **options)

    monkeypatch.setattr(release.store, "write", seen)
    release.table("simplerefsets")
    release.gathered = True
    release.table("concepts")
    assert gathered == {"simplerefsets": False, "concepts": True}


def test_a_copy_made_once_does_not_store_what_it_copies(spark, tmp_path):
    release = registered.fixtures.release(spark, MEDIUM)
    store = ReleaseStore(spark, str(tmp_path / "copies"))
    for table in ("simplerefsets", "relationships"):
        copied = registered._stored(release, store, "snomed_full_once").table(table)
        assert table not in release._tables
        assert copied.exceptAll(release.table(table)).isEmpty()
        assert release.table(table).exceptAll(copied).isEmpty()
    twice = registered._stored(release, store, "snomed_full_twice", once=False)
    twice.table("owlrefsets")
    assert "owlrefsets" in release._tables


def test_snapshots_of_packages_take_one_shuffle(spark, tmp_path):
    rows = [
        (8, 1, "F", "1995-01-01", 1.0), (9, 2, "O", "1995-02-01", 2.0), (8, 4, "O", "1996-01-01", 3.0),
        (9, 6, "F", "1996-02-01", 4.0), (10, 8, "P", None, 5.0), (11, 10, "O", "1994-01-01", 6.0),
        (None, 12, "F", "1994-01-01", 7.0), (None, 14, "O", "1997-01-01", 8.0),
    ]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string, o_totalprice double"
    orders = spark.createDataFrame(rows, columns).withColumn("o_orderdate", F.to_date("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = registered.fixtures.snapshot_table(spark, str(tmp_path), "concepts")
    usual = versions.snapshot(registered.fixtures.full_table(spark, str(tmp_path), "concepts"))
    assert sorted(map(str, found.collect())) == sorted(map(str, usual.collect()))
    shown = io.StringIO()
    with redirect_stdout(shown):
        found.explain("simple")
    initial = shown.getvalue().rpartition("== Initial Plan ==")[2]
    assert initial.count("Exchange hashpartitioning") == 1
