"""Per-customer state that new rentals are added to, instead of recomputing history.

Two tables: ``totals`` (one row per customer) and ``actors`` (one row per
customer and actor name). Everything but the opening period's revenue adds up;
that one is recomputed for customers whose first rental moved to an earlier
date, from the rentals so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.ranking import tiles
from marquee.operators.settle import settle
from marquee.operators.skew import lookup_join
from marquee.plans.facts import copy_titles, paid_rentals
from marquee.plans.lifecycle import (
    COLUMNS,
    Rules,
    average_gap,
    growth,
    period_end,
    three_favourites,
    watched_actors,
)
from marquee.sources.shop import Shop


END = T.StructType(
    [
        T.StructField("rental_date", T.TimestampNTZType()),
        T.StructField("rental_id", T.LongType()),
        T.StructField("title", T.StringType()),
    ]
)
TOTALS = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("first", END),
        T.StructField("last", END),
        T.StructField("total_revenue", T.DecimalType(28, 2)),
        T.StructField("num_of_rentals", T.LongType()),
        T.StructField("num_distinct_rentals", T.LongType()),
        T.StructField("early", T.DecimalType(28, 2)),
    ]
)
ACTORS = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("actor_id", T.LongType()),
        T.StructField("actor_name", T.StringType()),
        T.StructField("seen", T.LongType()),
    ]
)


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class State:
    totals: DataFrame
    actors: DataFrame

    def settled(self) -> State:
        return State(settle(self.totals, "state-totals"), settle(self.actors, "state-actors"))


def _early(rentals: DataFrame, firsts: DataFrame, rules: Rules) -> DataFrame:
    """Revenue inside the opening period that starts at ``firsts.first_rent_date``."""
    return (
        lookup_join(
            rentals.select("rental_id", "customer_id", "rental_date", "paid"),
            firsts.select("customer_id", "first_rent_date"),
            "customer_id",
            "inner",
        )
        .where(F.col("rental_date") < period_end(rules))
        .groupBy("customer_id")
        .agg(F.sum("paid").cast("decimal(28,2)").alias("early"))
    )


def collect_state(shop: Shop, rentals: DataFrame, rules: Rules = Rules()) -> State:
    """The state of ``rentals`` alone."""
    return _state_of(shop, _facts(shop, rentals), rules)


def _facts(shop: Shop, rentals: DataFrame) -> DataFrame:
    columns = ["rental_id", "customer_id", "rental_date", "inventory_id"]
    return settle(paid_rentals(shop, rentals.select(*columns), part=True), "state-facts")


def _state_of(shop: Shop, facts: DataFrame, rules: Rules) -> State:
    titled = lookup_join(facts, copy_titles(shop), "inventory_id")
    end = F.struct("rental_date", "rental_id", "title")
    totals = titled.groupBy("customer_id").agg(
        F.min(end).alias("first"),
        F.max(end).alias("last"),
        F.sum("paid").cast("decimal(28,2)").alias("total_revenue"),
        F.sum("joined_rows").alias("num_of_rentals"),
        F.count(F.lit(1)).alias("num_distinct_rentals"),
    )
    firsts = facts.groupBy("customer_id").agg(F.min("rental_date").alias("first_rent_date"))
    totals = totals.join(_early(facts, firsts, rules), "customer_id", "left").select(
        *totals.columns, F.coalesce("early", F.lit(0)).cast("decimal(28,2)").alias("early")
    )
    watched = titled.groupBy("customer_id", "film_id").agg(F.count("rental_id").alias("times"))
    return State(_typed(totals, TOTALS), _typed(watched_actors(shop, watched, rules), ACTORS))


def merge_state(state: State, shop: Shop, batch: DataFrame, rules: Rules = Rules()) -> State:
    """``state`` with the rentals of ``batch`` added.

    ``shop.rental`` holds the rentals so far, the batch included; it is read
    only for customers whose first rental date moved. State and rentals may be
    cut to the customers of the batch: then the result is theirs alone.
    """
    facts = _facts(shop, batch)
    fresh = _state_of(shop, facts, rules).settled()

    def both(old: Column, new: Column) -> Column:
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))

    old = state.totals.select("customer_id", F.struct(*state.totals.columns).alias("o"))
    new = fresh.totals.select("customer_id", F.struct(*fresh.totals.columns).alias("n"))
    joined = old.join(new, "customer_id", "full")
    merged = joined.select(
        "customer_id",
        F.least("o.first", "n.first").alias("first"),
        F.greatest("o.last", "n.last").alias("last"),
        both(F.col("o.total_revenue"), F.col("n.total_revenue")).cast("decimal(28,2)").alias("total_revenue"),
        both(F.col("o.num_of_rentals"), F.col("n.num_of_rentals")).alias("num_of_rentals"),
        both(F.col("o.num_distinct_rentals"), F.col("n.num_distinct_rentals")).alias("num_distinct_rentals"),
        F.col("o.early").alias("_old_early"),
        F.col("n.early").alias("_new_early"),
        F.col("o.first.rental_date").alias("_old_first"),
        F.col("n.first.rental_date").alias("_new_first"),
    )
    merged = settle(merged, "state-merged")
    known = F.col("_old_first").isNotNull()
    # Known customers: the batch adds what falls into the period they already have.
    same = merged.where(known & F.col("_new_first").isNotNull() & (F.col("_new_first") >= F.col("_old_first")))
    added = _early(facts, same.select("customer_id", F.col("_old_first").alias("first_rent_date")), rules)
    # Earlier first date: the period moved, so it is read again from all rentals.
    moved = merged.where(known & (F.col("_new_first") < F.col("_old_first"))).select(
        "customer_id", F.col("_new_first").alias("first_rent_date")
    )
    history = lookup_join(
        shop.rental.select("rental_id", "customer_id", "rental_date"),
        moved.select("customer_id"),
        "customer_id",
        "left_semi",
    )
    reread = _early(paid_rentals(shop, settle(history, "state-history"), part=True), moved, rules)
    early = (
        F.when(~known, F.col("_new_early"))
        .when(F.col("_new_first") < F.col("_old_first"), F.coalesce("reread", F.lit(0)))
        .otherwise(F.col("_old_early") + F.coalesce("added", F.lit(0)))
    )
    totals = (
        merged.join(added.withColumnRenamed("early", "added"), "customer_id", "left")
        .join(reread.withColumnRenamed("early", "reread"), "customer_id", "left")
        .withColumn("early", early.cast("decimal(28,2)"))
        .select(*state.totals.columns)
    )
    actors = (
        state.actors.unionByName(fresh.actors)
        .groupBy("customer_id", "actor_id", "actor_name")
        .agg(F.sum("seen").alias("seen"))
    )
    return State(totals, actors)


def lifecycle_of(state: State, rules: Rules = Rules()) -> DataFrame:
    """The lifecycle table a state stands for (chronological extremes only)."""
    if rules.extremes != "chronological":
        raise ValueError("state keeps chronological extremes only")
    totals = state.totals
    shown = F.col("last.title").isNotNull()
    if rules.single_rental == "null":
        shown = shown & (F.col("first.rental_id") != F.col("last.rental_id"))
    tiered = tiles(
        totals.select("customer_id", F.col("early").alias("thirty_days_revenue")),
        rules.tiers,
        [F.desc("thirty_days_revenue"), F.asc("customer_id")],
        "value_tier",
    )
    return (
        totals.select(
            "customer_id",
            F.col("first.rental_date").alias("first_rent_date"),
            "total_revenue",
            "num_of_rentals",
            "num_distinct_rentals",
            F.when(shown, F.col("first.rental_date")).alias("first_rental_date"),
            F.when(shown, F.col("first.title")).alias("first_film"),
            F.when(shown, F.col("last.rental_date")).alias("last_rental_date"),
            F.when(shown, F.col("last.title")).alias("latest_film"),
        )
        .withColumn("thirty_days_date", period_end(rules))
        .join(tiered, "customer_id", "left")
        .join(three_favourites(state.actors), "customer_id", "left")
        .withColumn("avg_time_days_between_rental", average_gap(rules))
        .withColumn("revenue_growth_rate", growth(rules))
        .select(*COLUMNS)
    )
