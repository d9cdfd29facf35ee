"""Importance resampling of documents toward the distribution of a target text collection.

Words are runs of letters, digits and everything beyond ASCII, A-Z lowered: a table of 256 bytes lowers and blanks in
one translation, which leaves UTF-8 whole, and bytes are split at the blanks. A feature is a run of up to ``width``
words joined by spaces; its CRC-32 continues that of the run without its last word, so no run is ever put together.
Features fall into ``buckets`` by their checksum. Each task counts its buckets, Spark sums them; the gain of a bucket
is the logarithm of how much likelier it is in the target, in thousandths. A document's weight is the mean gain of its
features, and its score adds Gumbel noise drawn from a hash of its id, so the highest scores are a sample without
replacement in proportion to the weights.

Texts are read twice, once to count and once to weigh; nothing of them is shuffled. Sent to the driver and back to the
tasks are two numbers per bucket, whatever the corpus. Ranking moves ids and scores, sorted over many tasks.

Defined results: null and empty texts, and those without a word, have no features and weight 0; a null id draws as an
empty one; long texts are split block by block; equal rows have equal scores and each counts; ties in the score go to
the smaller id, nulls last; an empty table gives an empty result, and an empty target leaves only the smoothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed, unpacked
from marquee.operators.ranking import row_numbers
from marquee.operators.settle import settle

BLOCK = 1 << 20  # bytes of a text that are split at once, unless a single word is longer
SPACE = 0x20


def _blanked(byte: int) -> int:
    if ord("A") <= byte <= ord("Z"):
        return byte + 32
    inside = ord("0") <= byte <= ord("9") or ord("a") <= byte <= ord("z") or byte >= 0x80
    return byte if inside else SPACE


TABLE = bytes(_blanked(byte) for byte in range(256))


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``width`` words, hashed into ``buckets``."""

    width: int = 2
    buckets: int = 10_000

    def of(self, raw: bytes) -> Iterator[tuple[int, list[int]]]:
        """The number of words, and the buckets of the features that end in it, of every block of a text."""
        before: list[bytes] = []  # words of earlier blocks that runs of this one may begin with
        for block in _blocks(raw.translate(TABLE)):
            words = before + block.split()
            old = len(before)
            sums = list(map(crc32, words))
            found = sums[old:]
            spaced = [b" " + word for word in words] if self.width > 1 else []
            for n in range(2, self.width + 1):
                sums = list(map(crc32, spaced[n - 1 :], sums))
                found += sums[max(0, old - n + 1) :]
            yield len(words) - old, [value % self.buckets for value in found]
            before = words[-(self.width - 1) :] if self.width > 1 else []


def _blocks(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        cut = data.find(b" ", start + BLOCK)
        cut = len(data) if cut < 0 else cut
        yield data[start:cut]
        start = cut


def _texts(array: pa.Array) -> Iterator[bytes]:
    for value in array.cast(pa.binary()):
        yield value.as_py() or b""


def bucket_counts(docs: DataFrame, features: Features = Features()) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts that fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for raw in _texts(batch.column(0)):
                for _, found in features.of(raw):
                    held.update(found)
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(held.keys(), pa.int64()), "n": pa.array(held.values(), pa.int64())}
        )

    counts = docs.select("text").mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, features: Features = Features()) -> list[int]:
    """Per bucket 1000 times the log of its share in ``target`` against that in ``source`` (bucket, n), add-one smoothed."""
    size = features.buckets
    both = [{row["bucket"]: row["n"] for row in counts.collect()} for counts in (source, target)]  # a row per bucket
    total_s, total_t = (float(sum(counts.values()) + size) for counts in both)
    out = []
    for bucket in range(size):
        s, t = (float(counts.get(bucket, 0) + 1) for counts in both)
        out.append(math.floor(1000 * math.log(t * total_s / (s * total_t))))
    return out


def weights(gain: Sequence[int], features: Features = Features()):
    """A column function: text -> struct of ``n_words``, ``n_features`` and ``weight``, the floored mean gain."""
    gain = list(gain)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = gain.__getitem__
        for batch in batches:
            columns: tuple[list[int], list[int], list[int]] = ([], [], [])
            for raw in _texts(batch):
                words = held = total = 0
                for n, found in features.of(raw):
                    words, held, total = words + n, held + len(found), total + sum(map(of, found))
                for column, value in zip(columns, (words, held, total // held if held else 0), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays(
                [pa.array(column, pa.int64()) for column in columns], ["n_words", "n_features", "weight"]
            )

    return F.arrow_udf(run, "struct<n_words:long,n_features:long,weight:long>")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")


def _scored(docs: DataFrame, gain: Sequence[int], seed: int, features: Features) -> DataFrame:
    rows = packed(docs, doc_id=F.col("doc_id"), found=weights(gain, features)("text"))
    return rows.select("row", "doc_id", "found.*", (F.col("found.weight") + noise(F.col("doc_id"), seed)).alias("score"))


def scored(docs: DataFrame, gain: Sequence[int], seed: int, features: Features = Features()) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    return unpacked(_scored(docs, gain, seed, features), docs, "n_words", "n_features", "weight", "score")


def ranked(scores: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scores`` (doc_id, n_words, score and more) with ``rank``: 1, 2, 3 for what is drawn, else null.

    Drawn are the highest ``percent`` of the documents with ``min_words`` or more.
    """
    scores = settle(scores, "scores")
    able = F.col("n_words") >= min_words
    drawn = scores.where(able).count() * percent // 100
    others = [F.col(name) for name in scores.columns if name not in ("doc_id", "score")]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), *others]  # rows that still tie are the same row
    numbered = row_numbers(scores.where(able), order, name="rank")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.unionByName(scores.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, features: Features = Features()
) -> DataFrame:
    """The rows of ``docs`` that are drawn toward ``target`` (text). Texts stay in place: they are scored once to find
    the last score and id that are drawn, and once more to keep what reaches them. Rows equal in both are drawn together.
    """
    gain = gains(bucket_counts(docs, features), bucket_counts(target, features), features)
    found = _scored(docs, gain, seed, features)
    places = ranked(found.select("doc_id", "n_words", "score"), percent, min_words)
    last = places.where(F.col("rank").isNotNull()).orderBy(F.desc("rank")).first()  # one row
    if last is None:
        return docs.limit(0)
    tied = F.col("score") == last["score"]
    first = F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("doc_id") <= F.lit(last["doc_id"]), F.lit(False))
    kept = found.where((F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | (tied & first)))
    return unpacked(kept, docs)
