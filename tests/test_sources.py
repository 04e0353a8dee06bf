from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from termwarden.plans.catalogue import CATALOGUE
from termwarden.plans.release import TABLES, Release
from termwarden.schemas import FULL_TABLES
from termwarden.sources.catalog import CatalogStore
from termwarden.sources.packages import (
    Package, load_full, load_snapshot, package_columns, release_name,
)
from termwarden.sources.scratch import shared_folder
from termwarden.sources.store import ReleaseStore
from tests.micro import CORE, FSN, IS, PREF, R, ROOT, SE, concept, make_release, rows

BASE = "Terms_InternationalRF2_PRODUCTION_20180131T120000Z"
EXTENSION = "Terms_ManagedServiceSE_PRODUCTION_SE1000052_20180531T120000Z"
HEADER = "id\teffectiveTime\tactive\tmoduleId\t"


def put(folder, name, lines, newline="\n"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(newline.join([*lines, ""]).encode())


def line(*values):
    return "\t".join(map(str, values))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """A base and an extension package, and snapshots of both."""
    root = tmp_path_factory.mktemp("packages with blanks")
    base, ext = root / BASE, root / EXTENSION
    intl, se = "INT_20180131", "SE1000052_20180531"
    head = HEADER + "definitionStatusId"
    for kind in ("Full", "Snapshot"):
        put(base, f"{kind}/Terminology/sct2_Concept_{kind}_{intl}.txt",
            [head, line(1, 20170731, 1, 2, 3), line(1, 20180131, 1, 2, 3)][: 3 if kind == "Full" else 2])
        put(ext, f"{kind}/Terminology/sct2_Concept_{kind}_{se}.txt",
            [head, line(1, 20170731, 0, SE, 9), line(900000000000000017, R, 1, SE, 3)])
        head_d = HEADER + "conceptId\tlanguageCode\ttypeId\tterm\tcaseSignificanceId"
        put(base, f"{kind}/Terminology/sct2_Description_{kind}-en_{intl}.txt",
            [head_d, line(11, R, 1, 2, 1, "en", FSN, 'A "quoted" \\ term (x)', 4)])
        put(ext, f"{kind}/Terminology/sct2_Description_{kind}-en_{se}.txt",
            [head_d, line(12, R, 1, SE, 1, "en", 5, "  blanks kept ", 4)])
        put(ext, f"{kind}/Terminology/sct2_Description_{kind}-sv_{se}.txt",
            [head_d, line(13, R, 1, SE, 1, "sv", 5, '"Åäö', 4), line(12, R, 1, SE, 1, "sv", 5, "late", 4),
             line(14, R, 1, SE, 1, "sv", 5, "", 4)], "\r\n")
        head_r = HEADER + "sourceId\tdestinationId\trelationshipGroup\ttypeId\tcharacteristicTypeId\tmodifierId"
        for name in ("Relationship", "StatedRelationship"):
            put(base, f"{kind}/Terminology/sct2_{name}_{kind}_{intl}.txt",
                [head_r, line(21, R, 1, 2, 1, ROOT, 0, IS, 7, 8)])
            put(ext, f"{kind}/Terminology/sct2_{name}_{kind}_{se}.txt", [head_r], "\r\n")
        head_l = HEADER + "refsetId\treferencedComponentId\tacceptabilityId"
        member = line("uuid-1", R, 1, 2, 7, 11, PREF)
        put(base, f"{kind}/Refset/Language/der2_cRefset_Language{kind}-en_{intl}.txt", [head_l, member], "\r\n")
        put(ext, f"{kind}/Refset/Language/der2_cRefset_Language{kind}-en_{se}.txt", [head_l, member])
        put(ext, f"{kind}/Refset/Language/der2_cRefset_Language{kind}-sv_{se}.txt", [head_l])
    head_m = HEADER + "refsetId\treferencedComponentId\tattributeDescription\tattributeType\tattributeOrder"
    put(base, f"Full/Refset/Metadata/der2_cciRefset_RefsetDescriptorFull_{intl}.txt",
        [head_m, line("rd", R, 1, 2, 5, 7, 1, 1, 0)], "\r\n")
    put(ext, f"Full/Refset/Metadata/der2_cciRefset_RefsetDescriptorFull_{se}.txt", [head_m])
    head_s = HEADER + "refsetId\treferencedComponentId"
    put(ext, f"Full/Refset/Content/der2_Refset_BSimpleFull_{se}.txt",
        [head_s, line("s1", R, 1, SE, 7, 200), line("s2", R, 1, SE, 7, 1)], "\r\n")
    put(ext, f"Full/Refset/Content/der2_Refset_ASimpleFull_{se}.txt", [head_s, line("s1", R, 1, SE, 7, 100)])
    return str(base), str(ext)


@pytest.fixture(scope="module")
def packages(folders):
    base = Package.base(folders[0], without={"owlrefsets", "simplerefsets"})
    return base, Package.extension(folders[1], without={"owlrefsets"})


def test_packages_are_named_by_their_folder(packages):
    base, extension = packages
    assert (base.scope, base.date, base.beta) == ("INT_20180131", 20180131, "")
    assert (extension.scope, extension.date) == ("SE1000052_20180531", 20180531)
    assert release_name(base, extension) == "snomed_full_SE1000052_20180531"
    assert release_name(base) == "snomed_full_20180131"
    beta = Package.extension(f"/some_where/x{EXTENSION}/")
    assert beta.files("relationships", "Full")[0].endswith(
        "xsct2_Relationship_Full_SE1000052_20180531.txt"
    )
    assert release_name(base, beta) == "xsnomed_full_SE1000052_20180531"
    with pytest.raises(ValueError):
        Package.base("/some/folder")


def test_package_of_a_row(spark, packages):
    paths = [f"file:/a_b/c/{BASE}/Full/x.txt", f"/x{EXTENSION}/Full/y.txt", "/none/z.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = df.select(*package_columns(F.col("path")).values())
    assert rows(found) == [
        ("20180131", 20180131, False), ("SE1000052_20180531", 20180531, True), ("", None, False),
    ]


def test_first_loaded_row_of_a_key_wins(spark, packages):
    loaded = load_full(spark, "concepts", *packages)
    assert loaded.schema.names == FULL_TABLES["concepts"].names
    assert sorted(rows(loaded)) == [
        (1, 20170731, 1, 2, 3), (1, 20180131, 1, 2, 3), (900000000000000017, R, 1, SE, 3),
    ]
    assert load_full(spark, "concepts", packages[0]).count() == 2


def test_terms_are_read_as_they_are(spark, packages):
    loaded = load_full(spark, "descriptions", *packages).select("id", "languageCode", "term")
    assert sorted(rows(loaded)) == [
        (11, "en", 'A "quoted" \\ term (x)'), (12, "en", "  blanks kept "), (13, "sv", '"Åäö'),
        (14, "sv", ""),
    ]


def test_line_ends_do_not_reach_the_last_column(spark, packages):
    members = load_full(spark, "languagerefsets", *packages)
    assert rows(members) == [("uuid-1", R, 1, 2, 7, 11, PREF)]
    assert rows(load_full(spark, "refsetdescriptors", *packages).select("attributeOrder")) == [(0,)]
    assert load_full(spark, "relationships", *packages).count() == 1


def test_simple_refsets_are_loaded_in_file_order(spark, packages):
    loaded = load_full(spark, "simplerefsets", *packages).select("id", "referencedComponentId")
    assert sorted(rows(loaded)) == [("s1", 100), ("s2", 1)]


def test_plans_do_not_grow_with_the_number_of_files(spark, tmp_path):
    """Many files of a pattern are ordered by their paths, not by a list in the plan."""
    def loaded(number):
        folder = tmp_path / str(number) / EXTENSION
        for i in range(number):
            put(folder, f"Full/Refset/Content/der2_Refset_S{i:05}Full_x.txt",
                [HEADER + "refsetId\treferencedComponentId", line(f"s{i % 7}", R, 1, SE, 7, i)])
        return load_full(spark, "simplerefsets", Package.extension(str(folder)))

    few, many = loaded(2), loaded(1500)
    assert sorted(r.referencedComponentId for r in many.collect()) == list(range(7))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(few) - size(many)) < 100


def test_missing_files(spark, packages):
    assert load_full(spark, "owlrefsets", *packages).count() == 0
    # What is not said to be absent has to be there.
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_full(spark, "simplerefsets", Package.base(packages[0].path))
    assert load_full(spark, "owlrefsets", *packages).schema.names == FULL_TABLES["owlrefsets"].names
    with pytest.raises(AnalysisException):
        load_full(spark, "concepts", Package.base("/none/" + BASE))


def test_order_within_a_file_split_over_tasks(spark, tmp_path, packages):
    lines = [line(i % 500, R, 1, i, 3) for i in range(20_000)]
    put(tmp_path / BASE, "Full/Terminology/sct2_Concept_Full_INT_20180131.txt",
        [HEADER + "definitionStatusId", *lines])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        loaded = load_full(spark, "concepts", Package.base(str(tmp_path / BASE)))
        assert sorted((r.id, r.moduleId) for r in loaded.collect()) == [(i, i) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_rows_are_an_error(spark, tmp_path):
    put(tmp_path / BASE, "Full/Terminology/sct2_Concept_Full_INT_20180131.txt",
        [HEADER + "definitionStatusId", line("x", R, 1, 2, 3)])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        load_full(spark, "concepts", Package.base(str(tmp_path / BASE))).collect()


def test_snapshot_packages(spark, packages):
    concepts = load_snapshot(spark, "concepts", *packages)
    # The base row stays although the extension has the same concept.
    assert sorted(r[:2] for r in rows(concepts)) == [(1, 20170731), (900000000000000017, R)]
    assert load_snapshot(spark, "stated", *packages).count() == 1
    # Language refsets have no key in a snapshot package.
    assert load_snapshot(spark, "languagerefsets", *packages).count() == 2


def test_release_from_packages(spark, packages, tmp_path):
    release = Release.load(spark, *packages, store=ReleaseStore(spark, str(tmp_path))).build()
    assert release.context.release_date == R
    assert rows(release.table("concepts_snap2").select("id", "fsn", "semtag")) == [
        (1, 'A "quoted" \\ term (x)', "x"),
    ]
    assert (1, ROOT, 1) in rows(release.table("transitiveclosure"))
    assert rows(release.store.releases()) == [("snomed_full_SE1000052_20180531",)]


@pytest.mark.parametrize("kind", ["files", "catalog"])
def test_stores(spark, release, tmp_path, kind):
    root = str(tmp_path / "store")
    store = ReleaseStore(spark, root) if kind == "files" else CatalogStore(spark, root, 4)
    full = {table: release.table(table) for table in FULL_TABLES}
    assert not store.has(release.name)
    Release(spark, release.name, full, release.context, store).build()
    listed = [r.release.lower() for r in store.releases().collect()]
    assert listed.count(release.name.lower()) == 1
    opened = Release.open(store, release.name)
    assert opened.context == release.context
    for table in TABLES:
        assert opened.table(table).columns == release.table(table).columns
        assert opened.table(table).dtypes == release.table(table).dtypes
        assert opened.table(table).exceptAll(release.table(table)).isEmpty()
        assert opened.table(table).count() == release.table(table).count()
    with pytest.raises(KeyError):
        Release.open(store, "snomed_full_20990101")
    # What only checks read may differ; what stored tables depend on may not.
    assert Release.open(store, release.name, core_module=1).context.core_module == 1
    with pytest.raises(ValueError, match="extension_module"):
        Release.open(store, release.name, extension_module=CORE)
    # A rebuild leaves what is listed alone until it is complete, and its readers after that.
    fewer = full | {"concepts": release.table("concepts").where("id % 3 = 0")}
    again = Release(spark, release.name, fewer, release.context, store)
    again.table("concepts")
    assert rows(Release.open(store, release.name).table("concepts").agg(F.count("*"))) == rows(
        release.table("concepts").agg(F.count("*"))
    )
    again.build()
    assert opened.table("concepts").exceptAll(release.table("concepts")).isEmpty()
    assert opened.table("transitiveclosure").count() == release.table("transitiveclosure").count()
    later = Release.open(store, release.name)
    assert later.table("concepts").where("id % 3 <> 0").isEmpty()
    if kind == "catalog":
        assert spark.table(f"{release.name}.concepts").count() == later.table("concepts").count()
    # Builds that are not listed are removed on request.
    assert len(store.prune(release.name)) == 1 and store.prune(release.name) == []
    assert Release.open(store, release.name).table("concepts").count() == later.table("concepts").count()
    store.withdraw(release.name)
    assert not store.has(release.name)
    assert release.name.lower() not in [r.release.lower() for r in store.releases().collect()]


@pytest.mark.parametrize("kind", ["files", "catalog"])
def test_a_release_added_to_another(spark, release, tmp_path, kind):
    """Only new rows are stored, and the earlier build is kept as long as it is part of it."""
    root = str(tmp_path / "added")
    store = ReleaseStore(spark, root) if kind == "files" else CatalogStore(spark, root, 4)
    time, split = F.col("effectiveTime"), 20001130
    part = lambda rows: {t: release.table(t).where(rows) for t in FULL_TABLES}
    first, second = f"b{kind}_snomed_full_20001130", f"b{kind}_snomed_full_20011130"
    Release(spark, first, part(time <= split), release.context, store).build()
    added = Release.added(Release.open(store, first), second, part(time >= split)).build()
    assert added.context.release_date == 20011130 and added.context.base_release_date == 20010131
    assert added.context.root_concept == release.context.root_concept
    opened = Release.open(store, second)
    assert added.published("descriptions").where(time <= split).isEmpty()
    for table in FULL_TABLES:
        assert opened.table(table).exceptAll(release.table(table)).isEmpty()
        assert opened.table(table).count() == release.table(table).count()
    whole = Release(spark, second, {t: release.table(t) for t in FULL_TABLES}, added.context)
    for check in ("new-concepts", "descriptions", "duplicate-descriptions"):
        assert rows(CATALOGUE.run(check, opened)) == rows(CATALOGUE.run(check, whole))
    if kind == "catalog":
        assert spark.table(f"{second}.concepts").count() == release.table("concepts").count()
    store.withdraw(first)
    assert store.prune(first) == []
    with pytest.raises(ValueError, match="is_a"):
        Release.added(opened, "snomed_full_20020531", {}, is_a=1)


def test_the_next_release_from_packages(spark, folders, packages, tmp_path):
    """The same packages again add nothing; a new one adds its rows."""
    store = ReleaseStore(spark, str(tmp_path / "next"))
    before = Release.load(spark, *packages, store=store).build()
    later = tmp_path / EXTENSION.replace("20180531", "20181130")
    for table in ("Relationship", "Concept"):
        put(later, f"Full/Terminology/sct2_{table}_Full_SE1000052_20181130.txt", [HEADER + "definitionStatusId"])
    head = HEADER + "definitionStatusId"
    put(later, "Full/Terminology/sct2_Concept_Full_SE1000052_20181130.txt",
        [head, line(900000000000000017, R, 1, SE, 3), line(900000000000000017, 20181130, 0, SE, 3)])
    missing = set(FULL_TABLES) - {"concepts"}
    base = Package.base(packages[0].path, without=missing)
    extension = Package.extension(str(later), without=missing)
    after = Release.load_next(before, base, extension)
    assert after.name == "snomed_full_SE1000052_20181130"
    assert rows(after.published("concepts")) == [(900000000000000017, 20181130, 0, SE, 3)]
    assert after.table("concepts").count() == before.table("concepts").count() + 1
    changed = {r.id: r.active for r in after.table("concepts_snap").collect()}
    assert changed[900000000000000017] == 0 and changed[1] == 1


@pytest.mark.parametrize("kind", ["files", "catalog"])
def test_open_keeps_the_context_of_the_build(spark, release, tmp_path, kind):
    root = str(tmp_path / "other")
    store = ReleaseStore(spark, root) if kind == "files" else CatalogStore(spark, root, 4)
    name = "snomed_full_core_20000531"
    full = {table: release.table(table) for table in FULL_TABLES}
    other = replace(release.context, extension_module=CORE)
    built = Release(spark, name, full, other, store).build()
    opened = rows(CATALOGUE.run("changed-concepts", Release.open(store, name)))
    assert opened == rows(CATALOGUE.run("changed-concepts", built))
    assert opened != rows(CATALOGUE.run("changed-concepts", release))


def test_dates_and_flags_are_pruned_by_partition(spark, release, capsys):
    release.table("descriptions").where(f"effectiveTime = {R}").explain()
    release.table("concepts_snap").where("active = 1").explain()
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters: [isnotnull(") == 2


def test_bucketed_tables_are_joined_without_a_shuffle(spark, release, tmp_path, capsys):
    store = CatalogStore(spark, str(tmp_path / "bucketed"), 4)
    full = {table: release.table(table) for table in FULL_TABLES}
    bucketed = Release(spark, "snomed_full_bucketed_20000531", full, release.context, store)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        concepts = bucketed.table("concepts_snap").where("active = 1")
        pairs = bucketed.table("transitiveclosure")
        joined = concepts.join(pairs, concepts["id"] == pairs["subtypeId"])
        joined.explain()
        assert "Exchange" not in capsys.readouterr().out
        assert joined.count() > 0
    finally:
        spark.conf.unset(threshold)


def test_releases_are_found_by_name(spark, tmp_path):
    store = ReleaseStore(spark, str(tmp_path / "names"))
    assert store.releases().count() == 0
    for name in ("snomed_full_20180131", "xsnomed_full_SE_20180531", "other", "a_snomed_b_full_c"):
        store.add_release(name, "{}")
    assert sorted(rows(store.releases())) == [
        ("a_snomed_b_full_c",), ("snomed_full_20180131",), ("xsnomed_full_SE_20180531",),
    ]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_tables_are_derived_once(spark):
    made = []

    def concepts():
        made.append(1)
        return make_release(spark, concepts=[concept(1)])._full["concepts"]

    release = make_release(spark)
    release._full = release._full | {"concepts": concepts}
    assert release.table("concepts").count() == release.table("concepts_snap").count() == 1
    assert len(made) == 1
    with pytest.raises(KeyError, match="no such table"):
        release.table("nothing")
