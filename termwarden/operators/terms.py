"""Looking concepts up by a term, however terms are compared.

The index is sorted by the comparison key over disjoint ranges, so that the statistics of
its files and row groups lead to the few that hold a term. Compared exactly, a term is its
own key; under a collation the key of all spellings that compare equal is the least of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.context import CheckContext
from termwarden.operators.skew import split_join
from termwarden.sources.scratch import WorkFolder


def term_index(
    descriptions_snap: DataFrame,
    named_concepts: DataFrame,
    hot_concepts: DataFrame,
    ctx: CheckContext,
    work: WorkFolder,
) -> DataFrame:
    """Active extension terms of active concepts, `(key, id, conceptId, term, fsn)`, sorted.

    A key may have any share of the rows: ranges are cut by key and id.
    """
    terms = descriptions_snap.where(
        (F.col("active") == 1) & (F.col("moduleId") == ctx.extension_module)
    ).select("id", "conceptId", "term")
    concepts = named_concepts.where("active = 1").select(F.col("id").alias("conceptId"), "fsn")
    found = split_join(terms, concepts, ["conceptId"], hot_concepts, spread="id")
    columns = ("id", "conceptId", "term", "fsn")
    if not ctx.collation:
        # The key is the term, and goes through the shuffle once.
        order = ("term", "id")
        ranged = found.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
        return ranged.select(F.col("term").alias("key"), *columns)
    # One row per spelling, so that a frequent one is split by the adaptive skew join.
    spellings = work.write("spellings", terms.select("term").distinct())
    of_group = F.min("term").alias("key")
    groups = spellings.groupBy(ctx.text_key(F.col("term")).alias("_group")).agg(of_group)
    compared = ctx.text_key(F.col("term")) == F.col("_group")
    keys = work.write("keys", spellings.join(groups, compared).select("term", "key"))
    keyed = found.join(keys, "term")
    order = ("key", "id")
    return (
        keyed.select("key", *columns)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


def term_keys(index: DataFrame, ctx: CheckContext) -> DataFrame:
    """The keys of an index, once each; none are needed where a term is its own key."""
    keys = index.select("key")
    return keys.distinct() if ctx.collation else keys.limit(0)


def keys_of(params: DataFrame, keys: DataFrame, ctx: CheckContext) -> DataFrame:
    """The keys of the terms in column `param`, `(key)`."""
    if not ctx.collation:
        return params.select(F.col("param").alias("key")).distinct()
    wanted = params.select(ctx.text_key(F.col("param")).alias("_group")).distinct()
    return keys.join(wanted, ctx.text_key(F.col("key")) == F.col("_group"), "left_semi")


def key_of(term: str, keys: DataFrame, ctx: CheckContext) -> str | None:
    """The key of one term; none if no spelling in the index compares equal."""
    if not ctx.collation:
        return term
    row = keys.where(ctx.text_key(F.col("key")) == ctx.text_key(F.lit(term))).first()
    return row and row.key
