"""Exact row numbers, tiles and ids over whole tables, and top-k per group.

Spark runs an unpartitioned window in one task, and a partitioned one runs a
group in one task. Here rows are range-partitioned and sorted by the full
order instead, so any group and any run of equal values is split over as many
tasks as it needs. ``order_by`` must order the rows totally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.settle import settle

# monotonically_increasing_id() holds the partition above these bits and the
# row's place in the partition below them.
PLACE_BITS = 33


def _placed(df: DataFrame, within: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """``df`` sorted across partitions, with ``_part`` and 0-based ``_place``."""
    order = [F.col(name).asc_nulls_first() for name in within] + list(order_by)
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return settle(ranged, "ranked").select(
        *df.columns,
        F.shiftright("_at", PLACE_BITS).alias("_part"),
        F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1).alias("_place"),
    )


def _numbered(placed: DataFrame, within: Sequence[str], name: str, total: str | None = None) -> DataFrame:
    # One row per partition and group: the windows below see, per group, at
    # most as many rows as there are partitions.
    runs = placed.groupBy("_part", *within).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    group = Window.partitionBy(*within)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run_part"),
        *[F.col(key).alias(f"_run_{key}") for key in within],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
        F.sum("_rows").over(group).alias("_total"),
    )
    same_run = F.col("_part") == F.col("_run_part")
    for key in within:
        same_run = same_run & F.col(key).eqNullSafe(F.col(f"_run_{key}"))
    columns = [F.col(c) for c in placed.columns if c not in ("_part", "_place")]
    columns.append((F.col("_place") + F.col("_offset")).cast("long").alias(name))
    if total:
        columns.append(F.col("_total").alias(total))
    return placed.join(runs, same_run).select(*columns)


def row_numbers(
    df: DataFrame,
    order_by: Sequence[Column],
    within: Sequence[str] = (),
    name: str = "row_number",
    total: str | None = None,
) -> DataFrame:
    """1-based row number by ``order_by`` inside each ``within`` group, and its size in a column ``total`` if named."""
    return _numbered(_placed(df, within, order_by), within, name, total)


def running_totals(df: DataFrame, value: str, order_by: Sequence[Column], within: Sequence[str], name: str) -> DataFrame:
    """The sum of ``value`` over the rows of a ``within`` group up to each row by ``order_by``.

    A group that fills several partitions is summed in each, and what earlier partitions hold of it is carried over.
    """
    placed = _placed(df, within, order_by)
    group = Window.partitionBy(*within)
    runs = placed.groupBy("_part", *within).agg(F.sum(value).alias("_sum"))
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_run_part"),
        *[F.col(key).alias(f"_run_{key}") for key in within],
        F.sum("_sum").over(earlier).alias("_before"),
    )
    inside = Window.partitionBy("_part", *within).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum(value).over(inside))
    same_run = F.col("_part") == F.col("_run_part")
    for key in within:
        same_run = same_run & F.col(key).eqNullSafe(F.col(f"_run_{key}"))
    total = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return summed.join(runs, same_run).select(*df.columns, total.alias(name))


def tiles(df: DataFrame, buckets: int, order_by: Sequence[Column], name: str = "tile") -> DataFrame:
    """``ntile(buckets)`` over the whole table."""
    numbered = _numbered(_placed(df, (), order_by), (), "_number", "_total")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    at = F.col("_number") - 1
    size = div(F.col("_total"), F.lit(buckets))
    extra = F.col("_total") % buckets
    wide = extra * (size + 1)  # rows in the first ``extra`` buckets, which hold one more
    bucket = F.when(at < wide, div(at, size + 1)).otherwise(
        div(at - wide, F.greatest(size, F.lit(1))) + extra
    )
    return numbered.withColumn(name, (bucket + 1).cast("int")).drop("_number", "_total")


def assign_ids(
    df: DataFrame, order_by: Sequence[Column], name: str = "id", start: int = 1
) -> DataFrame:
    """Dense ids in ``order_by`` order, as a sequence would hand them out."""
    numbered = row_numbers(df, order_by, name="_number")
    return numbered.select((F.col("_number") + (start - 1)).alias(name), *df.columns)


def top_k(df: DataFrame, k: int, within: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows of each group, numbered in ``place``.

    Spark trims every input partition to ``k`` rows per group before the
    shuffle, so a hot group arrives as ``k`` rows per task.
    """
    window = Window.partitionBy(*within).orderBy(*order_by)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
