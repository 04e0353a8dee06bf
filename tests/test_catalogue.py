from __future__ import annotations

import json

import pytest

from termwarden.plans import report
from termwarden.plans.catalogue import CATALOGUE, STATISTICS, Catalogue, CheckSpec, sql_check
from tests.micro import CORE, concept, description, make_release, rows


@pytest.fixture(scope="module")
def small(spark):
    return make_release(
        spark,
        concepts=[concept(1), concept(2, module=CORE), concept(3, active=0)],
        descriptions=[description(11, 1, "bad!"), description(12, 1, "fine")],
    )


def test_catalogue_lists_checks_without_parameter(spark):
    assert len(list(CATALOGUE)) == 20
    assert len(CATALOGUE.listed()) == 17
    listing = rows(CATALOGUE.listing(spark))
    assert [row[0] for row in listing] == [check.id for check in CATALOGUE.listed()]
    assert len(list(STATISTICS)) == 5


def test_unknown_checks_and_missing_parameters_are_errors(small):
    with pytest.raises(KeyError, match="new-concepts"):
        CATALOGUE.get("nothing")
    for empty in (None, ""):
        with pytest.raises(ValueError, match="needs a parameter"):
            CATALOGUE.run("concept-duplicate", small, empty)
    with pytest.raises(ValueError):
        CATALOGUE.run("multi-desc-lang-refset", small, "1 OR 1=1")
    assert rows(CATALOGUE.run("funky-chars", small, "needless")) == [(11, 1, "bad!", "sv")]


def test_explain_shows_the_plan(small):
    shown = CATALOGUE.explain("funky-chars", small)
    assert "Physical Plan" in shown and "translate" in shown


def test_checks_written_in_sql(small):
    catalogue = Catalogue(CATALOGUE)
    catalogue.register(
        sql_check(
            "published",
            "Concepts by module",
            """SELECT moduleId, count(*) AS ct FROM {concepts}
               WHERE effectiveTime = :release AND :base_release < :release GROUP BY moduleId""",
        )
    )
    catalogue.register(
        sql_check(
            "terms-of", "Terms of a concept", "SELECT conceptId AS param, term FROM {descriptions_snap}",
            nested=True, param_type=int,
        )
    )
    assert sorted(ct for _, ct in rows(catalogue.run("published", small))) == [1, 2]
    assert sorted(rows(catalogue.run("terms-of", small, "1"))) == [("bad!",), ("fine",)]
    assert "FROM {concepts}" in catalogue.explain("published", small)
    assert len(catalogue.listed()) == 18
    with pytest.raises(ValueError, match="exists already"):
        catalogue.register(CheckSpec("published", "again", lambda r: r.table("concepts")))


def test_envelope_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id long, term string")
    found = report.envelope(df, "some-check", "snomed_full_20180531", 5)
    assert rows(found) == [("some-check", "snomed_full_20180531", "5", '{"id":1,"term":null}')]


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_run_all_writes_every_check(spark, small, tmp_path, file_format):
    counts = dict(rows(report.run_all(small, str(tmp_path), file_format=file_format)))
    assert counts.keys() == {check.id for check in CATALOGUE.listed()}
    assert counts == {row[0]: row[2] for row in rows(report.check_counts(small))}
    assert counts["funky-chars"] == 1
    for check_id, expected in counts.items():
        folder = tmp_path / check_id
        if file_format == "parquet":
            assert spark.read.parquet(str(folder)).count() == expected
        else:
            lines = [x for f in folder.glob("part-*") for x in f.read_text().splitlines()]
            assert len(list(map(json.loads, lines))) == expected
    assert report.all_envelopes(small).count() == sum(counts.values())


def test_nothing_behind_other_checks(small):
    with pytest.raises(KeyError):
        report.drill_down(small, "new-concepts")
