"""Transitive closure of the Is-A graph, with shortest path lengths.

The closure is found by doubling: pairs at exactly the length reached so far are joined with
all pairs up to it, which gives the pairs up to twice that length. A graph of depth 1,000
takes ten rounds. When a release is added to one whose closure is stored, only the concepts
below a changed edge are followed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.sources.scratch import WorkFolder

PAIR = ("subtypeId", "supertypeId")


def is_a_edges(relationships_snap: DataFrame, ctx: CheckContext) -> DataFrame:
    """Distinct active Is-A edges `(subtypeId, supertypeId)`."""
    return _is_a_rows(relationships_snap.where("active = 1"), ctx).distinct()


def _is_a_rows(relationships: DataFrame, ctx: CheckContext) -> DataFrame:
    return relationships.where(F.col("typeId") == ctx.is_a).select(
        F.col("sourceId").alias("subtypeId"), F.col("destinationId").alias("supertypeId")
    )


def selves(concepts_snap: DataFrame) -> DataFrame:
    """Every active concept paired with itself, at length 0."""
    return concepts_snap.where(F.col("active") == 1).select(
        F.col("id").alias("subtypeId"),
        F.col("id").alias("supertypeId"),
        F.lit(0).alias("pathLength"),
    )


def transitive_closure(
    concepts_snap: DataFrame,
    relationships_snap: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """`(subtypeId, supertypeId, pathLength)`: active concepts to themselves with
    length 0, and every pair joined by active edges with its shortest length."""
    pairs = walks(is_a_edges(relationships_snap, ctx), work)
    return _with_selves(pairs, selves(concepts_snap))


def walks(edges: DataFrame, work: WorkFolder) -> DataFrame:
    """Pairs joined by one edge or more, with their shortest length; cycles included.

    Nothing leads over a concept without subtypes, and most concepts have none. Where at least
    half of the edges begin in such, the pairs of the others are found first, and theirs from
    those in one join.
    """
    edges = work.write("edges", edges)
    passed = edges.select(F.col("supertypeId").alias("subtypeId")).distinct()
    unknown = edges.where("subtypeId IS NULL")
    inner, count = _write(
        work, "inner", edges.join(passed, "subtypeId", "left_semi").select(*PAIR).unionByName(unknown)
    )
    if 2 * count > edges.count():
        return _doubled(edges, work)
    known = _doubled(inner, work)
    lowest = edges.join(passed, "subtypeId", "left_anti").where("subtypeId IS NOT NULL")
    onward = known.select(
        F.col("subtypeId").alias("supertypeId"),
        F.col("supertypeId").alias("next"),
        (F.col("pathLength") + 1).alias("pathLength"),
    )
    beyond = lowest.join(onward, "supertypeId").select(
        "subtypeId", F.col("next").alias("supertypeId"), "pathLength"
    )
    first = lowest.select(*PAIR, F.lit(1).alias("pathLength"))
    return known.unionByName(shortest(first.unionByName(beyond)).sortWithinPartitions(*PAIR))


def _doubled(edges: DataFrame, work: WorkFolder) -> DataFrame:
    """`walks` of stored edges, whatever concepts they begin in.

    A pair at a length above k and up to 2k leads over a concept at exactly k from its
    start, and what is left is a pair known already. So each round joins the pairs of
    length k with the known pairs of the concepts they end in, drops what is known, and
    doubles k; it ends when no pair of length k goes on. Pairs that end in a concept without
    a supertype, the root above all, are results but go on nowhere and enter no join, and
    known pairs are cut to the concepts that are asked for before they are shuffled.
    """
    growing = edges.select(F.col("subtypeId").alias("supertypeId")).distinct()
    level = work.write(
        "length_1",
        edges.join(growing.withColumn("grows", F.lit(True)), "supertypeId", "left").select(
            *PAIR, F.lit(1).alias("pathLength"), "grows"
        ),
    )
    known, length = level, 1
    while True:
        ends = level.where(F.col("grows") & (F.col("pathLength") == length))
        asked, waiting = _write(
            work, f"asked_{length}", ends.select(F.col("supertypeId").alias("middle")).distinct()
        )
        if not waiting:
            return known.select(*PAIR, "pathLength")
        onward = known.select(
            F.col("subtypeId").alias("middle"),
            F.col("supertypeId").alias("next"),
            F.col("pathLength").alias("more"),
            F.col("grows").alias("on"),
        ).join(asked, "middle", "left_semi")
        found = (
            ends.select("subtypeId", F.col("supertypeId").alias("middle"))
            .join(onward, "middle")
            .groupBy("subtypeId", F.col("next").alias("supertypeId"))
            .agg(F.min(F.col("more") + length).alias("pathLength"), F.first("on").alias("grows"))
            .join(known.select(*PAIR), list(PAIR), "left_anti")
            .select(*PAIR, "pathLength", "grows")
        )
        length *= 2
        level, new = _write(work, f"length_{length}", found)
        if not new:
            return known.select(*PAIR, "pathLength")
        known = known.unionByName(level)


def _with_selves(pairs: DataFrame, selves: DataFrame) -> DataFrame:
    """Pairs and selves together; where a cycle leads back to an active concept, length 0."""
    itself = F.col("subtypeId") == F.col("supertypeId")
    both = selves.unionByName(pairs.where(itself))
    return pairs.where(~itself).unionByName(shortest(both))


def shortest(pairs: DataFrame) -> DataFrame:
    """Shortest length of every pair."""
    return pairs.groupBy(*PAIR).agg(F.min("pathLength").alias("pathLength"))


def changed_subtypes(
    concepts_before: DataFrame,
    concepts_after: DataFrame,
    relationships_before: DataFrame,
    relationships_after: DataFrame,
    published_concepts: DataFrame,
    published_relationships: DataFrame,
    ctx: CheckContext,
) -> DataFrame:
    """Concepts that a new release gives another edge upwards or another activity, `(id)`.

    The snapshots are cut to the published rows' ids, and edges to the pairs that those
    rows name or named, so the snapshots themselves are not shuffled. An edge that several
    relationships state goes when the last of them does.
    """

    def named(rows: DataFrame) -> DataFrame:
        return _is_a_rows(rows.join(published_relationships.select("id"), "id", "left_semi"), ctx)

    asked = named(relationships_before).unionByName(named(relationships_after)).distinct()

    def state(rows: DataFrame, name: str) -> DataFrame:
        held = _is_a_rows(rows.where("active = 1"), ctx).join(asked, list(PAIR), "left_semi")
        return held.distinct().withColumn(name, F.lit(True))

    edges = (
        asked.join(state(relationships_before, "before"), list(PAIR), "left")
        .join(state(relationships_after, "after"), list(PAIR), "left")
        .where("before IS DISTINCT FROM after")
        .select(F.col("subtypeId").alias("id"))
    )

    def active(rows: DataFrame, name: str) -> DataFrame:
        held = rows.where("active = 1").join(published_concepts.select("id"), "id", "left_semi")
        return held.select("id", F.lit(True).alias(name))

    concepts = (
        published_concepts.select("id")
        .distinct()
        .join(active(concepts_before, "before"), "id", "left")
        .join(active(concepts_after, "after"), "id", "left")
        .where("before IS DISTINCT FROM after")
        .select("id")
    )
    return edges.unionByName(concepts).distinct()


def updated_closure(
    closure: DataFrame,
    changed: DataFrame,
    concepts_snap: DataFrame,
    relationships_snap: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """The closure of the new snapshots, from that of the old ones and the changed concepts.

    Only `changed` concepts and what was below them can have other supertypes now: the
    first changed edge on a way up is reached over edges that were there before. Their
    pairs are dropped and found again: they are followed upwards among themselves, and
    where a way leaves them, the old pairs of the concept it leads to go on from there.
    """
    changed = work.write("changed", changed)
    below = closure.join(changed.select(F.col("id").alias("supertypeId")), "supertypeId", "left_semi")
    affected = work.write(
        "affected", below.select(F.col("subtypeId").alias("id")).unionByName(changed).distinct()
    )
    subtypes = affected.select(F.col("id").alias("subtypeId"))
    supertypes = affected.select(F.col("id").alias("supertypeId"))
    edges = _is_a_rows(relationships_snap.where("active = 1"), ctx)
    inside = walks(edges.join(subtypes, "subtypeId", "left_semi").select(*PAIR).distinct(), work)
    leaving = inside.join(supertypes, "supertypeId", "left_anti")
    onward = closure.select(
        F.col("subtypeId").alias("supertypeId"),
        F.col("supertypeId").alias("next"),
        F.col("pathLength").alias("more"),
    )
    beyond = leaving.join(onward, "supertypeId").select(
        "subtypeId",
        F.col("next").alias("supertypeId"),
        (F.col("pathLength") + F.col("more")).alias("pathLength"),
    )
    own = selves(concepts_snap).join(subtypes, "subtypeId", "left_semi").select(*PAIR, "pathLength")
    again = shortest(inside.unionByName(beyond).unionByName(own))
    kept = closure.join(subtypes, "subtypeId", "left_anti").select(*PAIR, "pathLength")
    return kept.unionByName(again)


def descendant_counts(closure: DataFrame) -> DataFrame:
    """Number of descendants per concept, itself included: `(id, descendants)`.

    The top concepts hold most pairs; the count is combined before the shuffle.
    """
    return closure.groupBy(F.col("supertypeId").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("descendants")
    )


def with_descendants(concepts: DataFrame, closure: DataFrame) -> DataFrame:
    """Concepts with `descendants`, null for those that no pair leads to."""
    return concepts.join(descendant_counts(closure), "id", "left")


def _write(work: WorkFolder, name: str, df: DataFrame) -> tuple[DataFrame, int]:
    """Write a step of the loop; its rows are counted while they are written."""
    rows = Observation()
    stored = work.write(name, df.observe(rows, F.count(F.lit(1)).alias("n")))
    return stored, rows.get["n"]
