"""A training corpus from raw documents, in five stages.

Toxic documents go, one of each group of near-duplicates stays, documents with benchmark
items go, sources are mixed to their weights, and what is left is put into shards. Each
stage reads what the one before wrote. All but the last return the columns of `documents`;
the last adds `shard` and `slot`. No stage shuffles texts: what is decided about a document
is found out from its number, its fingerprint, sizes and digests, and looked up where the
document is read.

A stage called by itself leaves its steps in the shared folder until the session ends;
`run` removes those of each stage, and the result of the one before, once the stage is
written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.llm import decontamination, mixing, sharding, simhash, toxicity
from termwarden.llm.common import numbered, with_facts, work_folder
from termwarden.sources.scratch import WorkFolder

SHARDS = 40
#: Words of a shingle and differing bits of linked fingerprints.
SHINGLE, MOST_BITS = 4, 4


def remove_toxic(
    spark: SparkSession, docs: DataFrame, sf_dir: str, work: WorkFolder | None = None
) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, work=work)
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return toxicity.scored(whole, model).where("predicted = 0").select("_doc.*")


def remove_near_copies(
    spark: SparkSession, docs: DataFrame, sf_dir: str, work: WorkFolder | None = None
) -> DataFrame:
    """Of each component of linked fingerprints the row with the smallest id, then number.

    A component whose documents have no id keeps one of them; other texts that have the
    same id are judged by their own components.
    """
    work = work or work_folder(docs)
    stored = numbered(docs, work)
    light = stored.select("_row", "_doc.doc_id", "_doc.text")
    marked = simhash.near_duplicates(light, work, SHINGLE, MOST_BITS)
    # Rows of one component meet in an aggregate, never in a task.
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = marked.groupBy("component").agg(first["_row"].alias("_row")).select("_row")
    return with_facts(stored, kept, work, "kept")


def remove_benchmark_items(
    spark: SparkSession, docs: DataFrame, sf_dir: str, work: WorkFolder | None = None
) -> DataFrame:
    """Documents that contain no benchmark item, re-parameterised ones included."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.decontaminated(docs, benchmark, work)


def mix_sources(
    spark: SparkSession, docs: DataFrame, sf_dir: str, work: WorkFolder | None = None
) -> DataFrame:
    """Whole documents, so often that each source comes near its target."""
    return mixing.mixed_documents(docs, work=work)


def deal_shards(
    spark: SparkSession, docs: DataFrame, sf_dir: str, work: WorkFolder | None = None
) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.sharded(docs, SHARDS, work=work)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_benchmark_items),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Learned scores and fingerprints are beyond SQL; tests hold the stages against others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. The result is kept until the session ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        steps, result = work_folder(docs), work_folder(docs)
        docs = result.write(name, stage(spark, docs, sf_dir, steps))
        steps.delete()
        if before:
            before.delete()
        before = result
    return docs
