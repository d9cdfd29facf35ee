"""What searches over vectors share: usable rows, equal vectors as one, shards, blocks of queries, and the merge.

A shard is a bounded number of vectors that one task indexes; shards are dealt by a hash of the vector, after equal
vectors have become one row with their smallest ids, so a vector that a third of all rows hold is one row. Queries go
in bounded blocks to every shard of their dimension, and the best of each shard are merged per query. Index pages and
answers move, the index is never collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.settle import settle

KEY = ["dims", "shard"]


def usable(rows: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector without null or non-finite components; v in double precision.

    ``zero`` tells whether vectors of zeros count. Empty vectors never do.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    return rows.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Written distinct vectors of (vec_id, v) with their ``keep`` smallest ``ids``.

    Before the shuffle Spark trims each task to ``keep`` ids a vector.
    """
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    return settle(few.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")


def shards(rows: DataFrame, keep: int, shard_rows: int) -> tuple[DataFrame, int]:
    """Distinct vectors of (vec_id, v) with their ``keep`` smallest ``ids``, dealt to shards of about ``shard_rows``."""
    one = distinct_vectors(rows, keep)
    n = max(1, math.ceil(one.count() / shard_rows))
    dealt = one.withColumn("dims", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int"))
    return dealt, n


def log_length(v: Column) -> Column:
    """The logarithm of a vector's length, of any size; the vector is not zero."""
    most = F.array_max(F.transform(v, F.abs))
    return F.log(most) + F.log(F.aggregate(v, F.lit(0.0), lambda total, x: total + (x / most) * (x / most))) / 2


def search(
    index: DataFrame, queries: DataFrame, n_shards: int, block_rows: int, answer: Callable, k: int, score: str
) -> DataFrame:
    """Every query's best ``k`` of all shards: query_id, rank, vec_id, score.

    ``index`` has ``dims``, ``shard`` and rows that ``answer`` understands: it gets them and a block of queries
    (query_id, v) as frames and returns query_id, vec_id, score, which has the type ``score``.
    """
    queries = settle(queries.distinct(), "queries")
    n_blocks = max(1, math.ceil(queries.count() / block_rows))
    asked = queries.select(
        F.col("vec_id").alias("query_id"),
        "v",
        F.size("v").alias("dims"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"),
    )
    paged = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    key = [*KEY, "block"]

    def run(pages: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(pages) and len(block):
            return answer(pages, block)
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": []})

    found = paged.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    return best(found, k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: query_id, rank, vec_id, score."""
    order: list[Column] = [F.desc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def stacked(values) -> np.ndarray:
    return np.stack([np.asarray(v) for v in values])
