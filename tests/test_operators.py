from __future__ import annotations

import itertools
import random
from copy import copy
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termwarden.operators import closure, hierarchies, names, ranking, refsets, skew, versions
from termwarden.plans import release as release_plans
from termwarden.plans.catalogue import CATALOGUE
from termwarden.plans.checks import rowwise
from termwarden.plans.release import Release
from termwarden.schemas import FULL_TABLES
from termwarden.sources.scratch import WorkFolder
from termwarden.sources.store import ReleaseStore
from tests.micro import (
    CORE, FSN, IS, R, ROOT, SE, SYN, concept, description, frame, is_a, language, make_release, rows,
    simple,
)


def test_first_loaded_row_of_a_key_stays(spark):
    df = spark.createDataFrame(
        [(1, 10, "ext", 2), (1, 10, "int", 1), (1, 11, "ext", 3), (2, 10, "ext", 4)],
        "id long, effectiveTime int, origin string, place int",
    )
    kept = versions.first_loaded(df, ("place",)).select("id", "effectiveTime", "origin")
    assert sorted(rows(kept)) == [(1, 10, "int"), (1, 11, "ext"), (2, 10, "ext")]


def test_snapshot_takes_latest_versions_and_is_idempotent(spark):
    table = frame(spark, "concepts", [concept(1, 20100131), concept(1, R, 0), concept(2, 20100131)])
    latest = versions.snapshot(table)
    assert sorted((r.id, r.effectiveTime, r.active) for r in latest.collect()) == [
        (1, R, 0), (2, 20100131, 1),
    ]
    assert sorted(rows(versions.snapshot(latest))) == sorted(rows(latest))


def test_choosing_rows_limits_groups_before_the_shuffle(spark, capsys):
    table = frame(spark, "concepts", [concept(1)])
    versions.snapshot(table).explain()
    plan = capsys.readouterr().out
    exchange = plan.index("Exchange")
    assert "Partial" in plan[exchange:] and "Final" in plan[:exchange]


def test_marked_rows_are_those_of_both_rankings(spark, capsys):
    rng = random.Random(5)
    loaded = spark.createDataFrame(
        [
            (rng.choice([None, *range(30)]), rng.choice([None, 10, 11, 12]), rng.randint(0, 1), place)
            for place in range(400)
        ],
        "id long, effectiveTime int, active int, place int",
    )
    marked = versions.marked(loaded, ("place",))
    full = versions.first_loaded(loaded, ("place",))
    assert sorted(map(str, marked.drop(versions.LATEST).collect())) == sorted(map(str, full.collect()))
    latest = versions.latest(marked)
    assert sorted(map(str, latest.collect())) == sorted(map(str, versions.snapshot(full).collect()))
    versions._marked(loaded, ("place",)).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning(id") == 1


def test_copies_of_marked_tables_are_not_ranked_again(spark, tmp_path, capsys):
    versions_of = [concept(i, time) for i in range(1, 9) for time in (20100131, 20110131, R)[: 1 + i % 3]]
    loaded = frame(spark, "concepts", versions_of)
    made = make_release(spark)
    made._full["concepts"] = versions.marked(loaded, ("moduleId",))
    for store in (ReleaseStore(spark, str(tmp_path / "r")), made.store):
        copy_of = Release(spark, made.name, {"concepts": lambda: made.marked("concepts")}, made.context, store)
        again = Release(spark, made.name, {"concepts": lambda c=copy_of: c.marked("concepts")}, made.context, store)
        assert versions.LATEST not in copy_of.table("concepts").columns
        again.table("concepts")
        derived = again._derive("concepts_snap", again.work())
        derived.explain()
        assert "Exchange" not in capsys.readouterr().out
        expected = versions.snapshot(loaded)
        assert sorted(rows(derived)) == sorted(rows(expected))
    cut = Release(spark, made.name, {"concepts": made.table("concepts").where("effectiveTime < 20110131")}, made.context)
    assert {r.effectiveTime for r in cut.table("concepts_snap").collect()} == {20100131}


def test_extension_changes(spark):
    table = frame(spark, "concepts", [
        concept(1), concept(2, 20100131), concept(2), concept(3, 20100131, module=CORE),
        concept(3, active=0), concept(4, module=CORE), concept(5, 20100131),
    ])
    found = versions.extension_changes(table, R, SE).select("id", "versions", "active")
    assert sorted(rows(found)) == [(1, 1, 1), (2, 2, 1), (3, 2, 0)]


def test_name_of_a_concept_with_several(spark):
    release = make_release(
        spark,
        concepts=[concept(1), concept(2), concept(3), concept(4, active=0)],
        descriptions=[
            description(11, 1, "svensk (x)", "sv", FSN),
            description(12, 1, "old (a)", "en", FSN, time=20100131),
            description(13, 1, "new (b)", "en", FSN),
            description(14, 1, "new too (c)", "en", FSN),
            description(21, 2, "gone (d)", "en", FSN, time=20100131),
            description(21, 2, "gone (d)", "en", FSN, active=0),
            description(31, 3, "bara svenska", "sv", FSN),
            description(41, 4, "inactive (e)", "en", FSN),
        ],
    )
    named = release.table("concepts_snap2").select("id", "active", "fsn", "semtag")
    assert sorted(rows(named)) == [
        (1, 1, "new (b)", "b"), (3, 1, "bara svenska", "bara svenska"), (4, 0, "inactive (e)", "e"),
    ]
    several = names.ambiguous_names(release.table("descriptions_snap"), release.context)
    assert rows(several) == [(1, 4)]


def test_package_names_keep_all_concepts(spark):
    ctx = make_release(spark).context
    concepts = frame(spark, "concepts", [concept(1), concept(2, active=0), concept(3)])
    descriptions = frame(spark, "descriptions", [
        description(11, 1, "one (a)", "en", FSN), description(21, 2, "two (b)", "en", FSN),
    ])
    named = names.with_package_names(concepts, descriptions, ctx).select("id", "fsn", "semtag")
    assert sorted(rows(named)) == [(1, "one (a)", "a"), (2, "two (b)", None), (3, "", "")]


def run_closure(spark, concepts, edges):
    relationships = [is_a(i, a, b) for i, (a, b) in enumerate(edges)]
    result = closure.transitive_closure(
        frame(spark, "concepts", concepts),
        frame(spark, "relationships", relationships),
        make_release(spark).context,
        WorkFolder(spark),
    )
    found = rows(result)
    assert len({pair[:2] for pair in found}) == len(found)
    return sorted(found)


def shortest_paths(active, edges):
    lengths = {(a, a): 0 for a in active}
    nodes = set(itertools.chain(active, *edges))
    known = {}
    for start in nodes:
        frontier, length = {start}, 0
        while frontier:
            length += 1
            frontier = {b for a, b in edges if a in frontier}
            frontier -= {b for (s, b) in known if s == start}
            known |= {(start, b): length for b in frontier}
    return sorted((a, b, n) for (a, b), n in (known | lengths).items())


def test_closure_of_several_parents(spark):
    edges = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 1)]
    found = run_closure(spark, [concept(i) for i in (1, 2, 3, 4, 5)], edges)
    assert found == shortest_paths([1, 2, 3, 4, 5], edges)
    assert (5, 1, 1) in found


def test_closure_ignores_other_rows_but_not_inactive_sources(spark):
    relationships = [
        is_a(1, 2, 1), is_a(2, 3, 2, active=0), is_a(3, 4, 2, type=7), is_a(4, 5, 2), is_a(5, 5, 2),
    ]
    found = closure.transitive_closure(
        frame(spark, "concepts", [concept(1), concept(2), concept(5, active=0)]),
        frame(spark, "relationships", relationships),
        make_release(spark).context,
        WorkFolder(spark),
    )
    assert sorted(rows(found)) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (5, 1, 2), (5, 2, 1)]


def test_closure_without_edges(spark):
    assert run_closure(spark, [concept(1)], []) == [(1, 1, 0)]


def test_closure_ends_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (3, 6)]
    active = [1, 2, 4]
    found = run_closure(spark, [concept(i) for i in active], edges)
    assert found == shortest_paths(active, edges)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    edges=st.sets(st.tuples(st.integers(1, 7), st.integers(1, 7)), max_size=12),
    active=st.sets(st.integers(1, 7)),
)
def test_closure_of_any_graph(spark, edges, active):
    found = run_closure(spark, [concept(i) for i in active], sorted(edges))
    assert found == shortest_paths(sorted(active), edges)


def test_deep_chains_take_few_rounds(spark, monkeypatch):
    """The rounds grow with the logarithm of the depth."""
    depth, written = 1000, []
    chain = spark.range(depth).selectExpr("id + 2 AS subtypeId", "id + 1 AS supertypeId")
    write = WorkFolder.write
    monkeypatch.setattr(
        WorkFolder, "write", lambda self, name, *rest: written.append(name) or write(self, name, *rest)
    )
    pairs = closure.walks(chain, WorkFolder(spark))
    assert len([name for name in written if name.startswith("length_")]) <= 12
    assert pairs.count() == depth * (depth + 1) // 2
    assert pairs.where("pathLength <> subtypeId - supertypeId").isEmpty()


def release_steps(rng, nodes):
    """Random versions of concepts and relationships at two dates, cycles included."""
    def versions(make, ids, time):
        return [make(i, time) for i in ids if rng.random() < 0.7]

    def some_concept(i, time):
        return concept(i, time=time, active=int(rng.random() < 0.8))

    def some_edge(i, time):
        ends = rng.randrange(1, nodes + 1), rng.randrange(1, nodes + 1)
        return is_a(i, *ends, active=int(rng.random() < 0.8), time=time, type=IS if rng.random() < 0.9 else 7)

    concepts = versions(some_concept, range(1, nodes + 1), 20100131)
    edges = versions(some_edge, range(2 * nodes), 20100131)
    new_concepts = [some_concept(i, 20100731) for i in rng.sample(range(1, nodes + 3), 2)]
    new_edges = [some_edge(i, 20100731) for i in rng.sample(range(2 * nodes + 2), rng.randrange(4))]
    return concepts, edges, new_concepts, new_edges


@pytest.mark.parametrize("seed", range(10))
def test_updated_closure_of_any_change(spark, seed):
    rng = random.Random(seed)
    concepts, edges, new_concepts, new_edges = release_steps(rng, 9)
    ctx = make_release(spark).context
    full = {
        "before": (frame(spark, "concepts", concepts), frame(spark, "relationships", edges)),
        "new": (frame(spark, "concepts", new_concepts), frame(spark, "relationships", new_edges)),
    }
    before = [versions.snapshot(df) for df in full["before"]]
    after = [versions.merged(old, new) for old, new in zip(before, full["new"])]
    old = closure.transitive_closure(*before, ctx, WorkFolder(spark))
    changed = closure.changed_subtypes(
        before[0], after[0], before[1], after[1], full["new"][0], full["new"][1], ctx
    )
    found = rows(closure.updated_closure(old, changed, *after, ctx, WorkFolder(spark)))
    assert sorted(found) == sorted(rows(closure.transitive_closure(*after, ctx, WorkFolder(spark))))


@pytest.mark.parametrize("seed", range(3))
def test_merged_snapshot_is_that_of_all_versions(spark, seed):
    """Versions may also come late, and for components that are new."""
    rng = random.Random(seed)
    dates = [20100131, 20100731, 20110131]
    drawn = {(rng.randrange(20), rng.choice(dates)): rng.randrange(2) for _ in range(40)}
    split = {key: rng.random() < 0.5 for key in drawn}
    made = lambda late: [concept(i, time=t, active=a) for (i, t), a in drawn.items() if split[i, t] == late]
    before, new = (frame(spark, "concepts", made(late)) for late in (False, True))
    merged = versions.merged(versions.snapshot(before), new)
    assert sorted(rows(merged)) == sorted(rows(versions.snapshot(before.unionByName(new))))


def test_ranking_all_again_keeps_what_merging_keeps(spark):
    schema = "id long, effectiveTime int, active int"
    before = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 1, 1), (None, 2, 0)], schema)
    new = spark.createDataFrame([(1, 3, 0), (3, 3, 1), (None, 3, 1)], schema)
    expected = [(1, 3, 0), (2, 1, 1), (3, 3, 1), (None, 2, 0), (None, 3, 1)]
    merged = versions.merged(versions.snapshot(before), new)
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(expected, key=str)
    again = versions.reranked(before, new)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(expected, key=str)


def test_concepts_without_subtypes_are_followed_in_one_join(spark):
    """A chain and a cycle with many concepts below them, some of those below two."""
    inner = [(i, i - 1) for i in range(2, 6)] + [(7, 8), (8, 7), (8, 3)]
    lowest = [(100 + i, 1 + i % 8) for i in range(40)] + [(100 + i, 1 + i % 5) for i in range(0, 40, 3)]
    edges = sorted({*inner, *lowest})
    work = WorkFolder(spark)
    found = closure.walks(spark.createDataFrame(edges, "subtypeId long, supertypeId long"), work)
    # Nothing is active, so that cycles are pairs as well.
    assert sorted(rows(found)) == shortest_paths([], edges)
    # Rounds are made for the others alone.
    assert spark.read.parquet(f"{work.path}/length_1").count() == len(inner)


def test_descendants_include_the_concept(spark):
    concepts = frame(spark, "concepts", [concept(1), concept(2), concept(3, active=0)])
    pairs = spark.createDataFrame(
        [(1, 1, 0), (2, 2, 0), (2, 1, 1)], "subtypeId long, supertypeId long, pathLength int"
    )
    counted = closure.with_descendants(concepts, pairs).select("id", "descendants")
    assert sorted(rows(counted)) == [(1, 2), (2, 1), (3, None)]


def test_hierarchies(spark):
    release = make_release(
        spark,
        concepts=[concept(ROOT), concept(5), concept(7)],
        relationships=[
            is_a(1, 7, ROOT), is_a(2, 5, ROOT), is_a(3, 5, ROOT), is_a(4, 9, ROOT, active=0),
            is_a(5, 8, 5),
        ],
        descriptions=[
            description(10, ROOT, "Root (root)", "en", FSN),
            description(11, 5, "rotben", "sv"),
            description(12, 5, "andra namnet", "sv"),
            description(13, 5, "inte föredragen", "sv"),
            description(14, 5, "Five (tag)", "en", FSN),
            description(15, 5, "five", "en", SYN),
        ],
        languagerefsets=[
            language("a", 1, 12), language("b", 2, 11), language("c", 1, 13, acceptability=3),
            language("d", 1, 10, active=0),
        ],
    )
    found = release.table("hierarchies").orderBy("displayOrder")
    assert rows(found) == [
        (ROOT, "Root (root)", None, 1), (5, "Five (tag)", "rotben", 2), (7, None, None, 3),
    ]
    tops = hierarchies.top_concepts(
        spark, release.table("relationships_snap"), release.context, release.work()
    )
    assert sorted(rows(tops)) == [(5, 2), (7, 3), (ROOT, 1)]


def test_hierarchies_of_histories_are_those_of_snapshots(spark):
    """A term that went to another concept, a name that ended, a mark that moved and null ids."""
    concepts = [concept(ROOT), concept(1), concept(2)]
    edges = [is_a(1, 1, ROOT), is_a(2, 2, ROOT)]
    described = [
        description(11, 1, "old", time=R - 1), description(11, 2, "moved"),
        description(12, 1, "ended", "en", FSN, time=R - 1), description(12, 1, "ended", "en", FSN, active=0),
        description(13, 1, "kept", "en", FSN, time=R - 1), description(14, 9, "came", time=R - 1),
        description(14, 1, "came"), (None, *description(15, 2, "nobody", "en", FSN)[1:]),
    ]
    members = [
        language("a", 5, 11), language("b", 5, 14, time=R - 1), language("b", 5, 11),
        language("c", 5, 14, time=R - 1), language(None, 5, 14, time=R - 1), language(None, 5, 99),
    ]
    release = make_release(
        spark, concepts=concepts, relationships=edges, descriptions=described, languagerefsets=members
    )
    made = sorted(rows(release.table("hierarchies")), key=str)
    of_snapshots = hierarchies.hierarchies(
        spark, *(release.table(f"{t}_snap") for t in ("relationships", "descriptions", "languagerefsets")),
        release.context, release.work(),
    )
    assert made == sorted(rows(of_snapshots), key=str)
    assert (1, "kept", "came", 2) in made and (2, None, "moved", 3) in made
    assert not {"descriptions_snap", "languagerefsets_snap"} & stored_for_hierarchies(release)


def stored_for_hierarchies(release) -> set[str]:
    """Tables a fresh build of the release has stored once its hierarchies are there."""
    full = {table: release.table(table) for table in FULL_TABLES}
    fresh = Release(release.spark, release.name, full, release.context)
    fresh.table("hierarchies")
    return set(fresh._tables)


def test_numbers_are_consecutive_over_ranges(spark):
    ids = spark.range(0, 3000, 3).select((F.col("id") * 7919 % 3001).alias("k"))
    ids = ids.repartition(4)
    found = ranking.numbered(ids, "k", "place", 2, WorkFolder(spark))
    expected = [(k, place) for place, k in enumerate(sorted(r.k for r in ids.collect()), 2)]
    assert sorted(rows(found)) == expected
    empty = ranking.numbered(ids.where("k < 0"), "k", "place", 2, WorkFolder(spark))
    assert rows(empty) == []


def test_refsets_in_use(spark):
    members = {
        "language": frame(spark, "languagerefsets", [language("a", 1, 2), language("b", 1, 3, 0)]),
        "simple": frame(spark, "simplerefsets", [simple("c", 1, 2, 0)]),
    }
    assert sorted(rows(refsets.refsets_in_use(members))) == [
        ("language", 1, 2, 1), ("simple", 1, 1, 0),
    ]


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_split_join_gives_the_rows_of_a_plain_join(spark, how):
    left = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = skew.hot_keys(left, "k", rows_per_task=100)
    assert rows(hot) == [(7, 7)]
    plain = left.join(right, ["k"], how)
    split = skew.split_join(left, right, ["k"], hot, "id", how)
    assert split.columns == plain.columns
    assert sorted(rows(split)) == sorted(rows(plain))


def test_rows_are_repeated_in_chunks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0), ("d", 6)], "k string, n long")
    found = skew.repeat_rows(df, "n", "place", chunk=3)
    assert found.columns == ["k", "n", "place"]
    assert sorted((r.k, r.place) for r in found.collect()) == [
        *(("a", i) for i in range(1, 8)), ("b", 1), *(("d", i) for i in range(1, 7)),
    ]


def test_hot_rows_are_spread_over_slices(spark):
    left = spark.range(1000).select("id", F.lit(1).alias("k"))
    hot = skew.hot_keys(left, "k", rows_per_task=100)
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = skew.split_join(left, right, ["k"], hot, "id")
    assert joined.count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan


@pytest.mark.parametrize("name", ["hot_concepts_described", "hot_terms"])
def test_hot_keys_are_not_counted_in_the_task_that_stores_them(spark, capsys, name):
    terms = [description(10 + i, 1 + i % 3, f"term {i % 4}") for i in range(20)]
    named = [description(50 + i, 1 + i, f"name {i} (tag)", type=FSN) for i in range(3)]
    concepts = [concept(1 + i) for i in range(3)]
    release = make_release(spark, rows_per_task=2, concepts=concepts, descriptions=[*terms, *named])
    derived = release._derive(name, release.work())
    derived.explain()
    assert "Coalesce 1" not in capsys.readouterr().out
    assert derived.rdd.getNumPartitions() == 1
    assert {row.slices for row in release.table(name).collect()} == ({4} if "concepts" in name else {3})


def test_hot_keys_count_what_may_be_hot_alone(spark, capsys):
    rng = random.Random(3)
    keys = [rng.choice(["a"] * 30 + ["b"] * 20 + [None] * 15 + [f"k{i}" for i in range(60)]) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    counts = {k: keys.count(k) for k in set(keys)}
    for most in (1, 20, 100, 400, 2999, 5000):
        expected = {(k, -(-n // most)) for k, n in counts.items() if n > most}
        assert set(rows(skew.hot_keys(df, "k", most))) == expected
    skew.hot_keys(df, "k", 400).explain()
    assert "Filter" in capsys.readouterr().out
    empty = skew.hot_keys(df.limit(0), "k", 20)
    assert rows(empty) == [] and empty.columns == ["k", "slices"]


def test_every_pair_is_found_in_one_round(spark):
    """A ladder with many ways of each length: rounds write what is new, and only that."""
    edges = [(i, i - 1) for i in range(2, 31)] + [(i, i - 2) for i in range(3, 31)]
    work = WorkFolder(spark)
    found = closure.transitive_closure(
        frame(spark, "concepts", [concept(i) for i in range(1, 31)]),
        frame(spark, "relationships", [is_a(i, a, b) for i, (a, b) in enumerate(edges)]),
        make_release(spark).context,
        work,
    )
    assert sorted(rows(found)) == shortest_paths(range(1, 31), edges)
    written = [spark.read.parquet(f"{work.path}/length_{n}").count() for n in (1, 2, 4, 8, 16)]
    assert sum(written) == len(shortest_paths(range(1, 31), edges)) - 30
    assert all(written)


def test_every_date_added_makes_the_same_release(spark, release):
    """Snapshots, names, closure and counts of each date, added one after the other."""
    time = F.col("effectiveTime")
    dates = sorted(r[0] for r in release.table("concepts").select("effectiveTime").distinct().collect())
    tables = ("concepts_snap", "descriptions_snap", "relationships_snap", "concepts_snap2",
              "transitiveclosure", "language_terms")

    def part(rows):
        return {t: release.table(t).where(rows) for t in FULL_TABLES}

    name = lambda date: f"snomed_full_SE1000052_{date}"
    step = Release(spark, name(dates[-5]), part(time <= dates[-5]), release.context)
    for before, date in zip(dates[-5:], dates[-4:]):
        step = Release.added(step, name(date), part((time > before) & (time <= date)))
        whole = Release(spark, name(date), part(time <= date), release.context)
        for table in tables:
            assert step.table(table).exceptAll(whole.table(table)).isEmpty(), (date, table)
            assert step.table(table).count() == whole.table(table).count(), (date, table)


def test_many_new_rows_are_not_told_apart_from_the_rest(spark, release, monkeypatch):
    monkeypatch.setattr(release_plans, "FEW_ROWS", 100)
    time = F.col("effectiveTime")

    def part(rows):
        return {t: release.table(t).where(rows) for t in FULL_TABLES}

    before = Release(spark, "snomed_full_SE1000052_20001130", part(time <= 20001130), release.context)
    after = Release.added(before, "snomed_full_SE1000052_20011130", part(time > 20001130))
    whole = Release(spark, after.name, part(time > 0), release.context)
    derived = ("descriptions_snap", "concepts_snap2", "transitiveclosure", "language_terms")
    for table in derived:
        assert after.table(table).exceptAll(whole.table(table)).isEmpty(), table
        assert after.table(table).count() == whole.table(table).count(), table
    assert not set(derived) & set(before._tables)
    after.table("refsetdescriptors_snap")
    assert "refsetdescriptors_snap" in before._tables


def test_additions_read_new_dates_alone(spark, release):
    history = release.table("descriptions")
    new = release.work().write("new", history.where("effectiveTime = 20011130"))
    plan = versions.unpublished(history, new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [effectiveTime" in plan or "isnotnull(effectiveTime" in plan
    assert "= 20011130" in plan
    merged = versions.merged(release.table("descriptions_snap"), new)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # The published ids are broadcast, and only the touched rows are shuffled and ranked.
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning(id") == 1


def test_terms_are_looked_up_under_a_collation(spark):
    """Spellings that compare equal have one key, however many there are and in any case."""
    spellings = ["Ärm (x)", "ärm (X)", "ÄRM (x)  "]
    release = make_release(
        spark,
        rows_per_task=5,
        overrides={"collation": "UNICODE_CI_RTRIM"},
        concepts=[concept(i) for i in range(1, 40)],
        descriptions=[description(100 + i, i, f"name {i} (x)", "en", FSN) for i in range(1, 40)]
        + [description(200 + i, i, spellings[i % 3]) for i in range(1, 40)],
    )
    assert release.table("term_index").where("id >= 200").select("key").distinct().count() == 1
    # No spelling is frequent enough by itself.
    assert [r.slices for r in release.table("hot_terms").collect()] == [8]
    for term in (*spellings, "ärm (x)"):
        assert CATALOGUE.run("concept-duplicate", release, term).count() == 39
    assert CATALOGUE.run("concept-duplicate", release, "none").count() == 0
    asked = spark.createDataFrame([("ÄRM (X)",), ("ärm (x)",), ("name 3 (X)",)], "param string")
    assert CATALOGUE.get("concept-duplicate").build(release, asked).count() == 40
    # Another comparison than that of the build has tables of its own.
    exact = copy(release)
    exact.context = replace(release.context, collation=None)
    assert CATALOGUE.run("concept-duplicate", exact, "Ärm (x)").count() == 13
    release.close()


def test_a_term_is_read_from_few_row_groups(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        release = make_release(
            spark,
            concepts=[concept(i) for i in range(4000)],
            descriptions=[description(i, i, f"term {i} (x)", "en", FSN) for i in range(4000)],
        )
        found = CATALOGUE.run("concept-duplicate", release, "term 77 (x)")
        assert rows(found) == [(77, "term 77 (x)", "term 77 (x)")]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,term 77 (x))]" in scan.toString()
    assert scan.metrics().apply("numOutputRows").value() < 4000 / 2


def test_checks_of_single_descriptions_share_a_scan(release):
    shared = rowwise.sharing_scans(release)
    assert rowwise.sharing_scans(shared) is shared
    assert release.shared is None
    for check_id in rowwise.CONDITIONS:
        together, alone = CATALOGUE.run(check_id, shared), CATALOGUE.run(check_id, release)
        assert sorted(map(str, together.collect())) == sorted(map(str, alone.collect()))
        assert not any("/descriptions_snap/" in file for file in together.inputFiles())
        assert any("/descriptions_snap/" in file for file in alone.inputFiles())
