"""What several operators share.

Operators keep a caller's row in one struct column while they work, so that columns of the input may have any name,
also one that an operator uses itself. A column that an operator adds replaces an input column of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words, as in the contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Every row as the struct ``row``, beside the given columns."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame, *added: str) -> DataFrame:
    """The rows that ``packed`` put away, with the columns ``added``, which replace those of the same name."""
    taken = {name.lower() for name in added}
    kept = [F.col("row").getField(name).alias(name) for name in like.columns if name.lower() not in taken]
    return df.select(*kept, *added)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
