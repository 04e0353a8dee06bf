"""Traps of single checks, on rows made for them."""

from __future__ import annotations

import pytest

from termwarden.plans import report
from termwarden.plans.catalogue import CATALOGUE, STATISTICS
from tests.micro import (
    CORE, FSN, LANGUAGE_REFSET, R, ROOT, SE, concept, description, is_a, language, make_release,
    rows, simple,
)

OWN = 10000521  # any id with the extension's digits
FOREIGN = 77


def check(release, check_id, param=None):
    return rows(CATALOGUE.run(check_id, release, param))


def statistic(release, check_id):
    return rows(STATISTICS.run(check_id, release))


@pytest.fixture(scope="module")
def hierarchy_release(spark):
    return make_release(
        spark,
        concepts=[
            concept(ROOT, 20100131, module=CORE), concept(5, 20100131, module=CORE),
            concept(6, 20100131, module=CORE), concept(50), concept(51), concept(52, 20100131),
            concept(52), concept(53, active=0), concept(54, module=CORE), concept(55, 20100131),
            concept(55, active=0),
        ],
        relationships=[
            is_a(1, 5, ROOT), is_a(2, 6, ROOT), is_a(3, 50, 5), is_a(4, 50, 6), is_a(5, 51, 5),
            is_a(6, 52, 5),
        ],
        descriptions=[
            description(1, ROOT, "Root", "en", FSN), description(2, 5, "Five", "en", FSN),
            description(3, 5, "fem", "sv"), description(4, 50, "femtio", "sv"),
            description(5, 51, "inaktiv", "sv", active=0),
        ],
        languagerefsets=[language("a", LANGUAGE_REFSET, 3)],
    )


def test_new_concepts_count_once_per_hierarchy(hierarchy_release):
    assert check(hierarchy_release, "new-concepts") == [("Root", 2), ("Five", 2), (None, 1)]
    assert statistic(hierarchy_release, "new-concepts-by-term") == [
        (None, 2), ("fem", 2), (None, 1),
    ]


def test_changed_and_inactivated_concepts(hierarchy_release):
    assert check(hierarchy_release, "changed-concepts") == [("changed", 1), ("inactivated", 1)]
    assert statistic(hierarchy_release, "inactivated-concepts") == [(1,)]
    assert statistic(hierarchy_release, "new-concepts-by-status") == [(900000000000074008, 2)]


def test_non_translated_concepts(hierarchy_release):
    # 5 and 50 have an active extension-language term, 51 an inactive one.
    assert check(hierarchy_release, "non-translated") == [("Root", 4), ("Five", 2), (None, 1)]


def test_promoted_concepts(spark):
    base = 20170731
    own = [10000521, 10000522, 10000523, 10000524, 10000525]
    release = make_release(
        spark,
        concepts=[
            concept(own[0], 20100131), concept(own[0], base + 1, module=CORE),
            # known to the core before the base release
            concept(own[1], 20100131), concept(own[1], base, module=CORE),
            concept(own[1], base + 1, module=CORE),
            # never in the extension
            concept(own[2], base + 1, module=CORE),
            # without a name
            concept(own[3], 20100131), concept(own[3], base + 1, module=CORE),
            # the digits of the extension's other namespace do not count here
            concept(1000057, 20100131), concept(1000057, base + 1, module=CORE),
            # in the extension only from the release on
            concept(own[4], base + 1, module=CORE), concept(own[4], R - 1, module=CORE),
        ],
        descriptions=[
            description(i, c, f"c{i} (x)", "en", FSN)
            for i, c in enumerate([own[0], own[1], own[2], 1000057, own[4]])
        ],
    )
    assert check(release, "promoted-concepts") == [(own[0], "c0 (x)")]


def test_description_counts(spark):
    release = make_release(
        spark,
        concepts=[concept(1, 20100131, module=CORE), concept(1), concept(2)],
        descriptions=[
            description(11, 1, "ny"),
            description(12, 1, "inte ny", time=20100131), description(12, 1, "inte ny"),
            description(13, 2, "eget begrepp"),
            description(14, 1, "english", "en", module=CORE),
            description(15, 1, "borta", time=20100131), description(15, 1, "borta", active=0),
            description(16, 1, "fd kärna", time=20100131, module=CORE),
            description(16, 1, "fd kärna"),
        ],
    )
    assert check(release, "descriptions") == [
        ("new translations", 2),  # 11 and 16, whose earlier version was not the extension's
        ("new synonyms", 4),  # 11, 12, 14 and 16: any language and module
        ("inactivated descriptions", 1),
    ]
    assert statistic(release, "inactivated-descriptions") == [(1,)]


def test_synonyms_over_history_count_old_versions_too(spark):
    release = make_release(
        spark,
        descriptions=[
            description(11, 1, "ett", time=20100131), description(11, 1, "ett"),
        ],
    )
    assert check(release, "descriptions")[1] == ("new synonyms", 0)
    assert statistic(release, "new-synonyms") == [(1,)]


def test_counts_over_nothing_are_zero(spark):
    release = make_release(spark)
    assert check(release, "descriptions") == [
        ("new translations", 0), ("new synonyms", 0), ("inactivated descriptions", 0),
    ]
    assert check(release, "active-langrefset-inactive-descriptions") == [(0,)]
    assert check(release, "changed-concepts") == [("changed", 0), ("inactivated", 0)]
    assert statistic(release, "new-synonyms") == [(0,)]
    assert all(
        check(release, c.id) == [] for c in CATALOGUE.listed()
        if c.id not in ("descriptions", "changed-concepts", "active-langrefset-inactive-descriptions")
    )


def test_terms_with_characters_and_spaces(spark):
    release = make_release(
        spark,
        descriptions=[
            description(1, 9, "b!"), description(2, 9, "a!"), description(3, 9, "ok"),
            description(4, 9, "c!", "en"), description(5, 9, "core!", module=CORE),
            description(6, 9, "gone!", active=0), description(7, 9, "slut "),
        ],
    )
    assert check(release, "funky-chars") == [
        (4, 9, "c!", "en"), (2, 9, "a!", "sv"), (1, 9, "b!", "sv"),
    ]
    assert check(release, "descriptions-spaces") == [(7, "slut ")]


@pytest.fixture(scope="module")
def refset_release(spark):
    """Refset 100 has members on inactive concepts, 200 has none, 300 no term."""
    return make_release(
        spark,
        concepts=[
            concept(1, active=0), concept(2), concept(3, active=0), concept(100), concept(200),
            concept(300, active=0),
        ],
        simplerefsets=[
            simple("a", 100, 1), simple("b", 100, 1), simple("c", 100, 2), simple("d", 100, 3, 0),
            simple("e", 200, 2), simple("f", 200, 999), simple("g", 300, 1), simple("h", 400, 2),
            simple("i", 500, 2, active=0),
        ],
        descriptions=[
            description(11, 100, "hundra"), description(12, 100, "etthundra"),
            description(13, 100, "hundra", active=0), description(21, 200, "tvåhundra"),
            description(31, 300, "en", "en"), description(32, 100, "One hundred (tag)", "en", FSN),
            description(33, 300, "Three hundred (tag)", "en", FSN),
            description(34, 1, "inaktivt"), description(35, 1, "One (x)", "en", FSN),
        ],
        languagerefsets=[
            language("x", 7, 11), language("y", 8, 11, active=0), language("z", 7, 12),
            language("u", 7, 12, acceptability=5), language("v", 7, 21), language("w", 7, 13),
        ],
        refsetdescriptors=[("r", R, 0, SE, 9, 100, 1, 1, 0)],
    )


def test_refsets_with_inactive_multiply_by_marks(refset_release):
    with_inactive = [(100, "etthundra", 2), (100, "hundra", 4)]
    assert sorted(check(refset_release, "refsets-with-inactive")) == with_inactive
    assert sorted(check(refset_release, "refsets-with-inactive2")) == [
        *with_inactive, (200, "tvåhundra", 0),
    ]
    assert check(refset_release, "inactive-concepts-in-refsets") == [
        (100, "etthundra", 1), (100, "etthundra", 1), *[(100, "hundra", 1)] * 4,
    ]


def test_descriptions_of_a_refset_member(refset_release):
    expected = [(1, "One (x)", "One (x)"), (1, "inaktivt", "One (x)")]
    assert sorted(check(refset_release, "concept-refset-inactive", "1")) == expected
    drilled = rows(report.drill_down(refset_release, "inactive-concepts-in-refsets"))
    assert sorted(drilled) == [(1, *row) for row in expected]


def test_refset_ids_and_descriptors(refset_release):
    assert check(refset_release, "non-concept-refset-ids") == [(300,), (400,)]
    assert check(refset_release, "missing-refset-descriptors") == [(300, "Three hundred (tag)")]


def test_repeated_terms(spark):
    tables = {
        "concepts": [concept(1), concept(2), concept(3), concept(4, active=0)],
        "descriptions": [
            description(91, 1, "Ett (sak)", "en", FSN), description(92, 2, "Två (sak)", "en", FSN),
            description(93, 3, "Tre (Sak)", "en", FSN), description(94, 4, "Fyra (sak)", "en", FSN),
            description(11, 1, "lika"), description(12, 2, "lika"), description(13, 3, "lika"),
            description(14, 4, "lika"), description(15, 2, "Lika"), description(16, 1, "dubbel"),
            description(17, 1, "dubbel"), description(18, 1, "ensam"),
        ],
        "languagerefsets": [
            *(language(f"m{d}", LANGUAGE_REFSET, d) for d in range(11, 19)),
            language("again", LANGUAGE_REFSET, 18), language("other", 5, 15),
        ],
    }
    release = make_release(spark, **tables)
    assert check(release, "duplicate-descriptions") == [
        ("dubbel", "sak", 2), ("ensam", "sak", 2), ("lika", "sak", 2),
    ]
    assert sorted(check(release, "concept-duplicate", "lika")) == [
        (1, "lika", "Ett (sak)"), (2, "lika", "Två (sak)"), (3, "lika", "Tre (Sak)"),
    ]
    assert check(release, "concept-duplicate", "' OR 1=1 --") == []
    drilled = rows(report.drill_down(release, "duplicate-descriptions"))
    assert sorted(r[:2] for r in drilled) == [
        ("dubbel", 1), ("dubbel", 1), ("ensam", 1), ("lika", 1), ("lika", 2), ("lika", 3),
    ]
    # Case and accents do not count under a collation, but terms are grouped exactly.
    collated = make_release(spark, overrides={"collation": "UNICODE_CI_AI_RTRIM"}, **tables)
    assert check(collated, "duplicate-descriptions") == [
        ("lika", "Sak", 3), ("dubbel", "sak", 2), ("ensam", "sak", 2),
    ]
    assert len(check(collated, "concept-duplicate", "LIKA ")) == 4
    assert len(rows(report.drill_down(collated, "duplicate-descriptions"))) == 7


@pytest.fixture(scope="module")
def language_tables():
    return {
        "concepts": [concept(7), concept(8, active=0)],
        "descriptions": [
            description(71, 7, "Seven (refset)", "en", FSN),
            description(81, 8, "Eight (refset)", "en", FSN),
            description(1, 7, "english", "en"), description(2, 7, "svenska"),
            description(3, 7, "core", "en", module=CORE), description(4, 7, "borta", active=0),
        ],
        "languagerefsets": [
            language("a", 7, 1), language("b", 7, 1), language("c", 8, 2), language("d", 8, 2),
            language("e", 900000000000509007, 1), language("f", 7, 3), language("g", 7, 2),
            language("h", 7, 2, active=0), language("i", 7, 4), language("j", 7, 4),
            language("k", 9, 4, active=0), language("l", 7, 3, module=CORE),
        ],
    }


@pytest.mark.parametrize("rows_per_task", [None, 1])
def test_language_refsets(spark, language_tables, rows_per_task):
    release = make_release(spark, rows_per_task=rows_per_task, **language_tables)
    assert release.table("hot_language_members").isEmpty() == (rows_per_task is None)
    assert check(release, "active-langrefset-en-descriptions") == [("english", 1, 7)] * 2
    assert check(release, "active-langrefset-inactive-descriptions") == [(2,)]
    # Refset 8 is inactive, and the second member on 3 is not the extension's.
    assert check(release, "active-langrefset-multiple-descriptions") == [
        (7, "Seven (refset)", 1, "english"),
    ]
    found = CATALOGUE.run("multi-desc-lang-refset", release, 7)
    shown = found.select("member_id", "member_active", "desc_id", "desc_term")
    # 2 is held twice once inactive members count; they are not shown themselves.
    assert sorted(rows(shown)) == [
        ("a", 1, 1, "english"), ("b", 1, 1, "english"), ("f", 1, 3, "core"), ("g", 1, 2, "svenska"),
        ("l", 1, 3, "core"),
    ]
    drilled = report.drill_down(release, "active-langrefset-multiple-descriptions")
    assert sorted(rows(drilled.select("param", "member_id"))) == [(7, m) for m in "abfgl"]


def test_identifiers_outside_the_namespace(spark):
    release = make_release(
        spark,
        concepts=[concept(FOREIGN), concept(OWN), concept(78, module=CORE), concept(79, active=0)],
        descriptions=[
            description(FOREIGN, FOREIGN, "Seventy-seven (x)", "en", FSN),
            description(1000057, 9, "ours"), description(OWN, OWN, "own (x)", "en", FSN),
        ],
        relationships=[is_a(FOREIGN, OWN, ROOT), is_a(OWN, FOREIGN, ROOT)],
        languagerefsets=[language("m1", 7, FOREIGN), language("m2", 7, OWN)],
        owlrefsets=[
            ("o1", R, 1, SE, 9, FOREIGN, "Sub(:a)"), ("o1", 20100131, 1, SE, 9, FOREIGN, "Sub(:a)"),
            ("o2", R, 1, SE, 9, OWN, "Sub(:b)"), ("o3", R, 0, SE, 9, FOREIGN, "Sub(:c)"),
        ],
    )
    assert sorted(check(release, "se-module-with-non-se-ids")) == [
        ("axiom", "o1", "77 : Sub(:a)", 20100131),
        ("axiom", "o1", "77 : Sub(:a)", R),
        ("begrepp", "77", "Seventy-seven (x)", R),
        ("beskrivning", "77", "Seventy-seven (x)", R),
        ("lang-refset", "m1", "77", R),
        ("relation", "77", "10000521", R),
    ]


def test_hot_keys_do_not_change_results(spark, release):
    """With one row per task every repeated key is split."""
    from harness import fixtures
    from tests.conftest import SMALL

    split = fixtures.release(spark, SMALL)
    split.rows_per_task = 2
    assert not split.table("hot_concepts_described").isEmpty()
    for check_id, param in [
        ("inactive-concepts-in-refsets", None), ("active-langrefset-en-descriptions", None),
        ("concept-duplicate", "red widget (economy)"), ("concept-refset-inactive", 20001000052105),
        ("multi-desc-lang-refset", 1000052105),
    ]:
        expected = rows(CATALOGUE.run(check_id, release, param))
        assert sorted(rows(CATALOGUE.run(check_id, split, param))) == sorted(expected)
    for parent in ("duplicate-descriptions", "inactive-concepts-in-refsets"):
        expected = sorted(rows(report.drill_down(release, parent)))
        assert sorted(rows(report.drill_down(split, parent))) == expected
