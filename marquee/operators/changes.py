"""Keyed changes between snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.skew import lookup_join


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], newest_by: str | None = None) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key.

    With ``newest_by`` an old row stays when it is newer than its replacement.
    Both sides hold a key once.
    """
    key = list(key)
    if newest_by is None:
        return old.join(new, key, "left_anti").unionByName(new)
    # Each side is read once: both rows of a key meet, and one of them is taken whole.
    columns = [name for name in old.columns if name not in key]
    before = old.select(*key, F.struct(F.lit(True).alias("_is"), *columns).alias("_old"))
    after = new.select(*key, F.struct(F.lit(True).alias("_is"), *columns).alias("_new"))
    stays = F.col("_new._is").isNull() | F.coalesce(F.col(f"_new.{newest_by}") < F.col(f"_old.{newest_by}"), F.lit(False))
    chosen = [F.when(stays, F.col(f"_old.{name}")).otherwise(F.col(f"_new.{name}")).alias(name) for name in columns]
    return before.join(after, key, "full").select(*key, *chosen).select(*old.columns)


def stamp_changes(
    old: DataFrame, new: DataFrame, key: Sequence[str], as_of: Column, stamp: str = "last_update"
) -> DataFrame:
    """``new`` with ``stamp`` set to ``as_of`` on new and changed rows, else as it was."""
    key = list(key)
    values = [c for c in new.columns if c not in key and c != stamp]
    before = old.select(*key, F.struct(*values).alias("_old"), F.col(stamp).alias("_stamp"))
    changed = ~F.struct(*values).eqNullSafe(F.col("_old"))
    return (
        new.drop(stamp)
        .join(before, key, "left")
        .select(*key, *values, F.when(changed, as_of).otherwise(F.col("_stamp")).alias(stamp))
    )


def fill_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Nulls replaced by each column's default, in the column's type."""
    types = dict(df.dtypes)
    return df.withColumns(
        {name: F.coalesce(F.col(name), value.cast(types[name])) for name, value in defaults.items()}
    )


def delete_using(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner in ``other``."""
    return lookup_join(df, other.select(*on).distinct(), list(on), "left_anti")
