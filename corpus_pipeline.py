"""A corpus pipeline over ``documents``: each stage reads what the one before has written.

Documents without a known language go; lines that are boilerplate of their source go; of near copies one stays; sources
are mixed to target weights, which repeats documents; and texts are encoded as byte-level BPE. All stages but the last
return the columns of ``documents``. Models and statistics come from the stage's own input, over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, jaccard, langid, lines, mixing
from marquee.operators.settle import delete_path, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


BATCH_ROWS = 500  # documents that go to Python at once
TABLES = 0.3  # of the encoder's usual table sizes; its workers run beside a heap that earlier stages have filled


def _small_batches(spark: SparkSession) -> None:
    """Documents are long rows: in batches of Spark's usual 10,000 they would fill what Python leaves of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages are known: with a letter, and words that are certain by one half or more in the mean."""
    _small_batches(spark)
    return langid.keep_known(docs, langid.learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text."""
    cleaned = lines.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens, and whether decoding gives the text back."""
    _small_batches(spark)
    both = bpe.round_trip(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, TABLES)
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("both", both("text"))
    return rows.select(
        "doc_id",
        "source",
        F.col("both.ids").alias("ids"),
        F.size("both.ids").cast("long").alias("n_tokens"),
        (F.col("both.text") == F.col("text")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# No SQL can express the language model; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is deleted once its result is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            delete_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
