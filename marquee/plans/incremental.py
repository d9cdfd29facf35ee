"""Keeping the lifecycle current as rentals arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.changes import upsert
from marquee.operators.quality import check_unique
from marquee.operators.ranking import tiles
from marquee.operators.settle import settle
from marquee.operators.skew import lookup_join
from marquee.plans.lifecycle import COLUMNS, Lifecycle, Rules
from marquee.sources.buckets import Change
from marquee.sources.shop import Shop
from marquee.sources.versions import VersionedTable


@dataclass(frozen=True)
class Mark:
    """The newest rental already processed."""

    latest_date: object
    latest_id: object = None


def high_water_mark(rentals: DataFrame) -> DataFrame:
    """One row (latest_date, latest_id): the newest rental by date, then id."""
    newest = F.max(F.struct("rental_date", "rental_id")).alias("newest")
    return rentals.agg(newest).select(
        F.col("newest.rental_date").alias("latest_date"), F.col("newest.rental_id").alias("latest_id")
    )


def save_mark(rentals: DataFrame, control: VersionedTable) -> None:
    """Store the mark of ``rentals`` as a new version of the control table."""
    control.write(high_water_mark(rentals))


def read_mark(control: VersionedTable) -> Mark | None:
    """The stored mark; None before the first run."""
    if control.latest() is None:
        return None
    row = control.read().first()
    return Mark(row["latest_date"], row["latest_id"])


def new_rentals(rentals: DataFrame, mark: Mark | None, tie_safe: bool = False) -> DataFrame:
    """Rentals after the mark.

    By date alone, rentals at the very time of the mark are taken as processed;
    ``tie_safe`` compares (date, id) and finds those that came later.
    """
    if mark is None:
        return rentals
    date = F.lit(mark.latest_date).cast("timestamp_ntz")
    newer = F.col("rental_date") > date
    if tie_safe:
        newer = newer | ((F.col("rental_date") == date) & (F.col("rental_id") > F.lit(mark.latest_id)))
    return rentals.where(newer)


def touched_customers(new: DataFrame) -> DataFrame:
    return new.select("customer_id").distinct()


def with_history(rentals: DataFrame, new: DataFrame) -> DataFrame:
    """All rentals of the customers who have a new one."""
    return lookup_join(
        rentals,
        touched_customers(new),
        "customer_id",
        "left_semi",
    )


def staging_duplicates(staging: DataFrame) -> DataFrame:
    """Rentals of one customer, copy and time that were staged more than once."""
    return check_unique(staging, ["rental_date", "inventory_id", "customer_id"])


def lifecycle_increment(shop: Shop, new: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Fresh lifecycle rows of the customers in ``new``.

    ``shop.rental`` holds the rentals so far, the new ones included. Value
    tiers rank the customers of this increment among themselves.
    """
    staging = settle(with_history(shop.rental, new), "staging")
    return Lifecycle(shop.replace(rental=staging), rules, part=True).table()


def publish_increment(change: Change, increment: DataFrame, table: str = "lifecycle") -> None:
    """Put an increment's rows in place of older ones, in the buckets of its customers only."""
    merged = upsert(change.read(table, increment).select(*COLUMNS), increment, ["customer_id"], newest_by="last_rental_date")
    change.replace(table, merged)


def retier(lifecycle: DataFrame, tiers: int = 10) -> DataFrame:
    """Value tiers over the whole table."""
    ranked = tiles(
        lifecycle.drop("value_tier"),
        tiers,
        [F.desc_nulls_last("thirty_days_revenue"), F.asc("customer_id")],
        "value_tier",
    )
    return ranked.select(*COLUMNS)


def lifecycle_upsert(
    old: DataFrame, increment: DataFrame, tier_scope: str = "batch", tiers: int = 10
) -> DataFrame:
    """The lifecycle with the increment's rows in place of older ones.

    ``tier_scope="batch"`` keeps the tiers the rows came with, ``"all"`` ranks
    the merged table anew.
    """
    merged = upsert(old, increment, ["customer_id"], newest_by="last_rental_date")
    return retier(merged, tiers) if tier_scope == "all" else merged.select(*COLUMNS)
