"""Connected components by hooking, pointer jumping and contraction.

Each round hooks every node to its smallest neighbour, follows the hooks to their roots
and replaces the edges by edges between roots; at least half of the linked nodes go per
round. All steps are aggregates and joins with one row per node on the right side, over
written tables, so a node with any number of edges is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termwarden.sources.scratch import WorkFolder


def components(edges: DataFrame, work: WorkFolder) -> DataFrame:
    """`(node, root)` for every node with an edge; the root is the smallest node reachable.

    `edges` has long columns `a` and `b`, in any direction and number.
    """
    edges, left = _stored(_between(edges, F.col("a"), F.col("b")), work, "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    turn = 0
    while left:
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("root")
        )
        hooks = _jumped(work.write(f"hooks-{turn}", hooked), work, turn)
        to = lambda name: hooks.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b")
        known = roots.join(
            hooks.select(F.col("node").alias("root"), F.col("root").alias("_next")), "root", "left"
        ).select("node", F.coalesce("_next", "root").alias("root"))
        fresh = hooks.join(roots.select("node"), "node", "left_anti").select("node", "root")
        roots = work.write(f"roots-{turn}", known.unionByName(fresh))
        edges, left = _stored(_between(moved, F.col("_a"), F.col("_b")), work, f"edges-{turn}")
    return roots


def _between(rows: DataFrame, one, other) -> DataFrame:
    return (
        rows.where(one != other)
        .select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b"))
        .distinct()
    )


def _stored(edges: DataFrame, work: WorkFolder, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    stored = work.write(name, edges.observe(seen, F.count(F.lit(1)).alias("rows")))
    return stored, seen.get["rows"]


def _jumped(hooks: DataFrame, work: WorkFolder, turn: int) -> DataFrame:
    """Every node with the root at the end of its chain of hooks."""
    jump, moved = 0, 1
    while moved:
        jump += 1
        seen = Observation()
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        stepped = hooks.join(above, "root").select(
            "node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")
        )
        stepped = stepped.observe(seen, F.count_if("_moved").alias("moved"))
        hooks = work.write(f"hooks-{turn}-{jump}", stepped).drop("_moved")
        moved = seen.get["moved"]
    return hooks
