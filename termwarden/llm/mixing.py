"""Mixing sources to target weights by exact cuts in a random order.

Every document gets a hash-random key. Rows are range-sorted by source and key, and
distributed prefix sums of sizes say where each document lies in its source's order.
A source's budget is cut off that order at the exact word; where it is larger than the
source, whole epochs come first and the cut is made in the next one.

Targets: each source asks for its weight's share of the total, but gets at most
`most_epochs` times its size; what it cannot take is shared again by weight among the
others until none is above. That is the level L with target = min(weight * L, cap) for
all, found from prefix sums over the sources in the order of cap / weight.

Sources are told apart by code point, null is a source of its own and comes last.
Documents without words take nothing. Rows with equal ids and texts share a key and stand
next to each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termwarden.llm.common import WORD, numbered, running_sums, with_facts, work_folder
from termwarden.sources.scratch import WorkFolder


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most_epochs: int, work: WorkFolder
) -> DataFrame:
    """`(_source, _none, source_size, target, _start)` of every source.

    `sizes` has `_source` (empty for null), `_none` (null source) and `size`. `_start` is
    the sum of the sizes of all sources before.
    """
    spark = sizes.sparkSession
    # Hot sources are summed on the map side; there is one row per source from here on.
    totals = sizes.groupBy("_none", "_source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(
        totals.withColumn("_one", F.lit(1).cast("long")),
        ["_none", "_source"],
        ["source_size", "_one"],
        work,
        "sources",
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_one_before") % len(weights) + 1).cast("int"))
    capped = ranked.select(
        "_none",
        "_source",
        "source_size",
        F.col("source_size_before").alias("_start"),
        weight.cast("long").alias("_weight"),
        (F.col("source_size") * most_epochs).alias("_cap"),
    )
    levels = running_sums(
        capped.withColumn("_ratio", F.col("_cap") / F.col("_weight")),
        ["_ratio", "_none", "_source"],
        ["_cap", "_weight"],
        work,
        "levels",
    )
    words, weight_sum = levels.agg(F.sum("source_size"), F.sum("_weight")).first()
    wanted = share * (words or 0)
    # The first source in that order whose cap is not below its share sets the level.
    level = (F.lit(wanted) - F.col("_cap_before")) / (F.lit(weight_sum) - F.col("_weight_before"))
    reached = levels.where(F.col("_ratio") >= level).agg(F.min(F.struct("_ratio", level.alias("level")))).first()[0]
    target = F.col("_cap").cast("double")
    if reached is not None:
        target = F.least(target, F.col("_weight") * F.lit(reached.level))
    return work.write(
        "targets", levels.select("_none", "_source", "source_size", "_start", target.alias("target"))
    )


def _mixed(
    docs: DataFrame,
    carried: Sequence[str],
    weights: Sequence[int],
    share: float,
    most_epochs: int,
    seed: int,
    work: WorkFolder | None = None,
) -> DataFrame:
    """`_doc` (the carried columns) with size, source_size, target, copies and cut."""
    work = work or work_folder(docs)
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256)
    keyed = docs.select(
        F.struct(*carried).alias("_doc"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
        F.substring(key, 1, 32).alias("_key"),
    )
    placed = running_sums(keyed, ["_none", "_source", "_key"], ["size"], work, "placed")
    sources = source_targets(
        placed.select("_none", "_source", "size"), weights, share, most_epochs, work
    )
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("copies") * F.col("source_size")
    into_it = rest - (F.col("size_before") - F.col("_start"))
    return (
        placed.join(sources, ["_none", "_source"])
        .withColumn("copies", whole.cast("long"))
        .withColumn("cut", F.greatest(F.lit(0), F.least("size", into_it)).cast("long"))
    )


def taken_words(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Per document `(doc_id, size, source_size, target, taken, copies, cut)`.

    `copies` are the whole epochs that take the document, `cut` the words that the last,
    partial epoch takes of it, and `taken` all words: `copies * size + cut`.
    """
    rows = _mixed(docs, ["doc_id"], weights, share, most_epochs, seed)
    taken = F.col("copies") * F.col("size") + F.col("cut")
    return rows.select(
        "_doc.doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "cut"
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: int = 2,
    seed: int = 17,
    work: WorkFolder | None = None,
) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, each text whole.

    The document that a budget cuts through is taken once more if the cut leaves at least
    half of it in, so a source misses its target by half a document at most. Only keys and
    sizes are sorted; texts stay where they are read.
    """
    work = work or work_folder(docs)
    stored = numbered(docs, work)
    light = stored.select("_row", "_doc.doc_id", "_doc.text", "_doc.source")
    rows = _mixed(light, ["_row"], weights, share, most_epochs, seed, work)
    once_more = (F.col("cut") > 0) & (F.col("cut") * 2 >= F.col("size"))
    times = F.col("copies") + once_more.cast("long")
    taken = rows.where(times > 0).select("_doc._row", times.alias("_times"))
    found = with_facts(stored.select("_row", F.struct("_doc").alias("_doc")), taken, work, "taken")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_doc.*")
