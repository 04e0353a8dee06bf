"""Relations between results that hold on any release."""

from __future__ import annotations

from pyspark.sql import functions as F

from termwarden.operators.versions import snapshot
from termwarden.plans.catalogue import CATALOGUE, STATISTICS
from tests.micro import rows


def check(release, check_id):
    return rows(CATALOGUE.run(check_id, release))


def statistic(release, check_id):
    return rows(STATISTICS.run(check_id, release))


def test_snapshot_of_a_snapshot(release):
    latest = release.table("descriptions_snap")
    assert snapshot(latest).exceptAll(latest).isEmpty()
    assert latest.groupBy("id").count().where("count > 1").isEmpty()


def test_closure_is_transitive_and_lengths_are_shortest(release):
    pairs = release.table("transitiveclosure")
    on = pairs.select(F.col("subtypeId").alias("supertypeId"), F.col("supertypeId").alias("top"),
                      F.col("pathLength").alias("more"))
    two_steps = pairs.join(on, "supertypeId").select(
        "subtypeId", F.col("top").alias("supertypeId"),
        (F.col("pathLength") + F.col("more")).alias("length"),
    )
    missing = two_steps.join(pairs, ["subtypeId", "supertypeId"], "left").where(
        "pathLength IS NULL OR pathLength > length"
    )
    assert missing.isEmpty()


def test_refset_counts_agree(release):
    with_zeros = check(release, "refsets-with-inactive2")
    assert sorted(check(release, "refsets-with-inactive")) == sorted(
        row for row in with_zeros if row[2] > 0
    )
    members = check(release, "inactive-concepts-in-refsets")
    assert sum(row[2] for row in with_zeros) == len(members)


def test_statistics_agree_with_checks(release):
    changed = dict(check(release, "changed-concepts"))
    assert statistic(release, "inactivated-concepts") == [(changed["inactivated"],)]
    descriptions = dict(check(release, "descriptions"))
    assert statistic(release, "inactivated-descriptions") == [
        (descriptions["inactivated descriptions"],)
    ]
    by_term = statistic(release, "new-concepts-by-term")
    assert [row[1] for row in by_term] == [row[1] for row in check(release, "new-concepts")]
