"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, graph, importance, jaccard, langid, lines, lm, merkle, mixing, mtree, pii, urls, warc
from marquee.llm.common import table
from marquee.operators.settle import scratch_path

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.with_copies(docs, mixing.targets_of(docs))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    there_and_back = bpe.round_trip(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = table(spark, folder, "documents").select("doc_id", there_and_back("text").alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("both.ids")).alias("ids_sha256"),
        F.sha2(F.col("both.text"), 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return lines.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.groups(table(spark, folder, "documents"), jaccard.Similarity(4, 85, 100))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.exact_top_k(table(spark, folder, "embeddings"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nearest(table(spark, folder, "embeddings"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes come from ``labels``: the page of a labelled document is good if of quality and not toxic."""
    labels = table(spark, folder, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.judge(pages, labels.select(F.col("doc_id").alias("page_id"), good.alias("good")), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans")
    )


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    field = langid.learn(docs)
    asked = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.label(asked, field).select("doc_id", "held_out", "lang_pred", "score")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


def op12_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(target))
    scores = importance.scored(docs, gain, seed=7).drop("text")
    return importance.ranked(scores, percent=25, min_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_lm(spark: SparkSession, folder: str) -> DataFrame:
    fold = lm.remainder(F.col("doc_id"), 7)
    return lm.score(table(spark, folder, "documents"), fold == 2, fold == 3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_bpe, op3_line_dedup, op4_jaccard, op5_top_k, op6_warc, op7_neighbours, op8_url_filter, op9_pii,
        op10_language, op11_merkle, op12_importance, op13_lm,
    )
}
