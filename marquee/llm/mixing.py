"""Mixing sources to target weights, each document emitted a whole number of times.

Sizes are summed per source with map-side aggregation, so a source with a third of all rows arrives as one row per
task. A document of a source with repetition rate r is emitted floor(r) times, and once more if its draw lies below
the fraction of r. The draw is a hash of seed, id and text: it needs no state, and a lost task repeats it. Rows that are
equal in source, id and text draw together: n of them are emitted floor(n r) times and once more by the draw for the
rest, dealt evenly, so a row that is repeated a thousand times takes a thousand times what one takes. They are found by
a count of digests; only repeated rows are numbered, sorted over many tasks.

Defined results: a null or empty text has size 0; a null source is a source of its own, ordered last; an empty table gives an empty mix; sources without a target, or without words, are not emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed, unpacked, word_count
from marquee.operators.ranking import row_numbers
from marquee.operators.settle import settle

DRAW_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, exact in a double


def source_sizes(docs: DataFrame) -> DataFrame:
    """``source`` and ``source_size``, its words."""
    return docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))


def cyclic_weights(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sizes`` with a ``weight`` dealt out in turn, by the code points of the sources."""
    ranked = row_numbers(sizes, [F.col("source").asc_nulls_last()], name="place")
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", dealt).drop("place")


def capped_targets(weighted: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``weighted`` with a ``target``: ``share`` of all words by weight, no source above ``limit`` times its size.

    What a source at its limit cannot take goes to the others by weight. The level (words per weight) rises until no
    further source reaches its limit; each round reads one row of sums, and a source changes sides only once.
    """
    most = F.col("source_size") * F.lit(limit)
    total = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, weights = share * (total[0] or 0), total[1] or 0.0
    level, full = (goal / weights if weights else 0.0), 0
    while True:
        row = weighted.where(most <= F.col("weight") * F.lit(level)).agg(
            F.count(F.lit(1)), F.sum(most), F.sum("weight")
        ).first()
        if row[0] == full:
            break
        full, rest = row[0], weights - row[2]
        if rest <= 0:
            level = float("inf")
            break
        level = (goal - row[1]) / rest
    reached = F.lit(0.0) if goal == 0 else F.least(most, F.col("weight") * F.lit(level))
    return weighted.withColumn("target", reached.cast("double"))


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on seed, id and text alone."""
    parts = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def with_copies(docs: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; ``targets`` has the last but one per source."""
    chosen = targets.select(F.col("source").alias("of"), "source_size", "target")
    equal = [F.col("source"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")]
    held = docs.select(*equal).groupBy("source", "doc_id", "digest").agg(F.count(F.lit(1)).alias("held"))
    repeated = settle(held.where(F.col("held") > 1), "mix-repeated").select(
        *[F.col(name).alias(f"same_{name}") for name in ("source", "doc_id", "digest")], "held"
    )
    same = F.lit(True)
    for name in ("source", "doc_id", "digest"):
        same = same & F.col(name).eqNullSafe(F.col(f"same_{name}"))
    rows = packed(
        docs,
        size=word_count(F.col("text")),
        source=F.col("source"),
        doc_id=F.col("doc_id"),
        digest=equal[2],
        draw=draw(seed, F.col("doc_id"), F.col("text")),
    )
    rows = rows.join(repeated, same, "left").drop("same_source", "same_doc_id", "same_digest")
    single = rows.where(F.col("held").isNull()).withColumns({"held": F.lit(1).cast("long"), "place": F.lit(1).cast("long")})
    # Which of the equal rows comes first does not matter; the id of the row spreads them over tasks.
    several = rows.where(F.col("held").isNotNull()).withColumn("any", F.monotonically_increasing_id())
    several = row_numbers(several, [F.asc("any")], within=["source", "doc_id", "digest"], name="place").drop("any")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_rate = F.coalesce(rate, F.lit(0.0)) * F.col("held")
    dealt = F.floor(all_rate) + (F.col("draw") < all_rate - F.floor(all_rate)).cast("long")
    copies = F.call_function("div", dealt, F.col("held")) + (F.col("place") <= dealt % F.col("held")).cast("long")
    joined = single.unionByName(several).join(chosen, F.col("source").eqNullSafe(F.col("of")), "left")
    return unpacked(joined.withColumn("copies", copies), docs, "size", "source_size", "target", "copies")


def targets_of(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """A written table of ``source``, ``source_size``, ``weight`` and ``target``; Spark knows its size when joining."""
    weighted = settle(cyclic_weights(source_sizes(docs), weights), "mix-weights")
    return settle(capped_targets(weighted, share, limit), "mix-targets")


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken."""
    counted = with_copies(docs, targets if targets is not None else targets_of(docs), seed)
    rows = packed(counted, copies=F.col("copies").cast("int"))
    repeated = rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return unpacked(repeated, docs)
