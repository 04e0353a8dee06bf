"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termwarden.llm import (
    chunking,
    conversations,
    decontamination,
    exact_dedup,
    language_model,
    mixing,
    pii,
    secrets,
    sharding,
    simhash,
    toxicity,
    urls,
    vectors,
)
from termwarden.llm.common import fold_of, work_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    """Scores of every text by a model of the texts that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id")) == 1
    model = language_model.train(docs.where(~held_out), order)
    return language_model.scored(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


def language_model_order_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by trigrams."""
    return op1_language_model(spark, sf_dir, 3)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with how much of each."""
    docs = table(spark, sf_dir, "documents")
    return decontamination.leaked_items(docs, table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url, by the rules or its host's place in the link graph."""
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four or fewer differing bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = simhash.near_duplicates(docs, work_folder(docs), words=4, most_bits=4)
    return rows.select(
        "doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


def op5_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that occur more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    passages = chunking.repeated_passages(rows, work_folder(docs))
    return passages.select("doc_id", "start", "end", "chunks", "repeats", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.span_digests(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 40 shards."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("text_digest"),
    )
    return sharding.sharded(rows, 40, digest="text_digest").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a lexicon learned on four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out_fold=0)
    return toxicity.scored(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of equal texts, by a digest index built from all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, f"{work_folder(docs).path}/index")
    return exact_dedup.deduplicated(docs, index)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage has been put in."""
    given = table(spark, sf_dir, "conversations")
    return conversations.summarised(given, conversations.damaged(given), work_folder(given))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector, by codebooks of 256 entries for each of four parts."""
    given = table(spark, sf_dir, "embeddings")
    return vectors.code_digests(given, work_folder(given))


def queries() -> dict[str, Query]:
    from corpus_pipeline import run as pipeline

    return {
        "op1_language_model": op1_language_model,
        "op2_decontamination": op2_decontamination,
        "op3_url_filter": op3_url_filter,
        "op4_simhash": op4_simhash,
        "op5_chunking": op5_chunking,
        "op6_mixing": op6_mixing,
        "op7_secrets": op7_secrets,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_personal_data": op11_personal_data,
        "op12_conversations": op12_conversations,
        "op13_vector_codes": op13_vector_codes,
        "language_model_order_three": language_model_order_three,
        "pipeline": pipeline,
    }
