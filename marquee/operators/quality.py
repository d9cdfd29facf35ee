"""Declared rules as jobs: each returns what breaks the rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.sources.catalog import FOREIGN_KEYS, RATINGS, TABLES, UNIQUE, YEARS
from marquee.sources.shop import Shop


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _repeated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, with their row count; nulls are equal to each other.

    In two passes: first the rows are counted by a 64-bit digest of the values, so what is shuffled is a number a row
    however wide the values are. Only rows whose digest occurs again are counted by the values themselves.
    """
    digest = F.xxhash64(*columns)
    again = df.select(digest.alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    some = df.select(*columns, digest.alias("_digest")).join(again.select("_digest"), "_digest", "left_semi")
    return some.groupBy(*columns).agg(F.count(F.lit(1)).alias("num_rows")).where(F.col("num_rows") > 1)


def check_primary_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their row count."""
    null = _any([F.col(c).isNull() for c in key])
    missing = df.where(null).groupBy(*key).agg(F.count(F.lit(1)).alias("num_rows"))
    return _repeated(df.where(~null), key).unionByName(missing)


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once; rows with a null are never equal."""
    return _repeated(df.dropna(subset=list(columns)), columns)


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child values without a parent, with their row count.

    The child is reduced to its distinct values before the join, so a value
    held by many rows is one row there.
    """
    values = (
        child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("num_rows"))
    )
    return values.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns holding nulls, with how many; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("num_nulls")) for c in columns]
    )
    return counts.select(F.inline(entries)).where(F.col("num_nulls") > 0)


def check_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows whose value lies outside ``low``..``high``; nulls pass."""
    return df.where(~F.col(column).between(low, high))


def check_allowed(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Rows whose value is not one of ``allowed``; nulls pass."""
    return df.where(~F.col(column).isin(list(allowed)))


def check_length(df: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Rows with a text longer than its column allows."""
    return df.where(_any([F.coalesce(F.length(c) > n, F.lit(False)) for c, n in lengths.items()]))


def check_precision(df: DataFrame, column: str, precision: int, scale: int) -> DataFrame:
    """Rows whose number has too many whole digits once rounded to ``scale``; nulls pass."""
    limit = Decimal(10) ** (precision - scale)
    return df.where(F.abs(F.round(F.col(column).cast("decimal(38,10)"), scale)) >= F.lit(limit))


def check_shop(shop: Shop, tables: Sequence[str] | None = None) -> DataFrame:
    """(table_name, rule, columns, violations) for every declared rule of the given
    tables (all of the catalogue by default)."""
    names = list(tables or TABLES)
    found = []

    def add(table: str, rule: str, columns: Sequence[str], bad: DataFrame, amount: Column) -> None:
        found.append(
            bad.agg(F.coalesce(amount, F.lit(0)).cast("long").alias("violations")).select(
                F.lit(table).alias("table_name"),
                F.lit(rule).alias("rule"),
                F.lit(", ".join(columns)).alias("columns"),
                "violations",
            )
        )

    every = F.count(F.lit(1))
    for name in names:
        table, df = TABLES[name], getattr(shop, name)
        add(name, "primary key", table.key, check_primary_key(df, table.key), every)
        for columns in UNIQUE.get(name, []):
            add(name, "unique", columns, check_unique(df, columns), every)
        for child, column, parent in FOREIGN_KEYS:
            if child == name:
                key = TABLES[parent].key[0]
                bad = check_foreign_key(df, column, getattr(shop, parent), key)
                add(name, "foreign key", [column], bad, F.sum("num_rows"))
        add(name, "not null", table.required, check_not_null(df, table.required), F.sum("num_nulls"))
        if table.lengths:
            add(name, "length", list(table.lengths), check_length(df, table.lengths), every)
        if name == "film":
            add(name, "allowed", ["rating"], check_allowed(df, "rating", RATINGS), every)
            add(name, "range", ["release_year"], check_range(df, "release_year", *YEARS), every)
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result
