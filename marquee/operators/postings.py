"""Word postings of texts and conjunctive search over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"

# Words too common to index.
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i if in is it its not of on or she "
    "that the their them they this to was we were will with you"
).split()


def token_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """(term, doc_id, tf): how often each word occurs in each text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("term"))
        .where(~F.col("term").isin(list(stop_words)))
        .groupBy("term", "doc_id")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def match_all_terms(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids of the texts that hold every term, with the terms' total count."""
    wanted = sorted({term.lower() for term in terms})
    return (
        postings.where(F.col("term").isin(wanted))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("_found"), F.sum("tf").alias("tf"))
        .where(F.col("_found") == len(wanted))
        .select("doc_id", "tf")
    )
