"""Word postings that follow their texts, and search over them.

Postings (term, doc_id, tf) lie in hash buckets of the term, sorted by it, so a search reads the files of its words only,
and of those the row groups that may hold them. A text that changes is not looked for in the postings it had: its new
ones are added with the number of the change, ``docs`` keeps the number of each text's last change, and a posting counts
if both are the same. ``tidy`` rewrites the buckets without outdated postings once these are many.

How many texts hold a term is kept beside them; a search begins with the rarest term and meets the others with what is
left. That number is a guess where texts have changed since the last ``tidy``: it orders the work, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.postings import STOP_WORDS, token_index
from marquee.operators.settle import passing, settle
from marquee.sources.buckets import BucketStore, Keyed

LONG = T.LongType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in kinds.items()])


POSTINGS = _schema(term=T.StringType(), doc_id=LONG, tf=LONG, since=LONG)
DOCS = _schema(doc_id=LONG, since=LONG)
TERMS = _schema(term=T.StringType(), texts=LONG)
MOST_PARTS = 8  # of a bucket of postings before they are put together


class KeptIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, stop_words: Sequence[str] = STOP_WORDS):
        self.spark, self.stop_words = spark, tuple(stop_words)
        self.store = BucketStore(
            spark,
            path,
            {
                "postings": Keyed(POSTINGS, ("term",), buckets, ("term", "doc_id")),
                "docs": Keyed(DOCS, ("doc_id",), buckets),
                "terms": Keyed(TERMS, ("term",), buckets, ("term",)),
            },
        )

    def update(self, texts: DataFrame, gone: DataFrame | None = None) -> int:
        """Index ``texts`` (doc_id, text), new or in place of what they were, and drop the texts ``gone`` (doc_id)."""
        change = self.store.change()
        since = F.lit(change.version).cast("long").alias("since")
        with passing(self.spark):
            texts = settle(texts.select("doc_id", "text").where(F.col("doc_id").isNotNull()), "texts")
            found = token_index(texts, stop_words=self.stop_words).select("term", "doc_id", "tf", since)
            found = change.append("postings", found)
            change.merge("postings", MOST_PARTS)
            keys = texts.select("doc_id")
            if gone is not None:
                change.delete("docs", gone, ["doc_id"])
            change.replace("docs", keys.distinct().select("doc_id", since))
            change.append("terms", found.groupBy("term").agg(F.count(F.lit(1)).alias("texts")))
            change.merge("terms", MOST_PARTS)
            return change.publish()

    def tidy(self) -> int:
        """Drop outdated postings, and count the terms anew."""
        change = self.store.change()
        with passing(self.spark):
            valid = settle(self._valid(change.read("postings"), change.read("docs")), "valid")
            change.write("postings", valid)
            change.write("terms", valid.groupBy("term").agg(F.count(F.lit(1)).alias("texts")))
            return change.publish()

    @staticmethod
    def _valid(postings: DataFrame, docs: DataFrame) -> DataFrame:
        return postings.join(docs, ["doc_id", "since"], "left_semi").select(*POSTINGS.names)

    def postings(self) -> DataFrame:
        """(term, doc_id, tf) of the texts as they are now."""
        return self._valid(self.store.read("postings"), self.store.read("docs")).drop("since")

    def of_terms(self, terms: Sequence[str]) -> DataFrame:
        """Stored postings of some terms, outdated ones among them: scans the files of their buckets."""
        asked = self.spark.createDataFrame([(term,) for term in terms], "term string")
        buckets = self.store.buckets_of("postings", asked)
        held = self.store.scan("postings", buckets)
        return held.where(F.col("term").isin(list(terms)))

    def match_all_terms(self, terms: Sequence[str]) -> DataFrame:
        """Ids of the texts that hold every term, with the terms' total count."""
        wanted = sorted({term.lower() for term in terms})
        asked = self.spark.createDataFrame([(term,) for term in wanted], "term string")
        counts = self.store.read("terms", asked).groupBy("term").agg(F.sum("texts").alias("texts"))
        known = {row["term"]: row["texts"] for row in counts.collect()}  # a row per term asked
        if not wanted or len(known) < len(wanted):
            return self.spark.createDataFrame([], "doc_id long, tf long")
        first, *others = sorted(wanted, key=lambda term: (known[term], term))
        found = self._valid(self.of_terms([first]), self.store.read("docs")).select("doc_id", "since", "tf")
        for term in others:
            more = self.of_terms([term]).select("doc_id", "since", F.col("tf").alias("more"))
            found = found.join(more, ["doc_id", "since"]).select("doc_id", "since", (F.col("tf") + F.col("more")).alias("tf"))
        return found.select("doc_id", "tf")
