"""Average value per store and month without the extreme customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.exact import cents, round_ratio
from marquee.operators.ranking import tiles
from marquee.operators.settle import settle
from marquee.operators.skew import lookup_join
from marquee.plans.facts import paid_rentals
from marquee.sources.shop import Shop

DIGITS = 6


def mid_value_store_month(
    shop: Shop, year: int, buckets: int = 10, low: int = 2, high: int = 9, grain: str = "row"
) -> DataFrame:
    """Average amount per month and store over customers in value tiles ``low``..``high``.

    Customers are tiled by what they paid for the year's rentals, ties by id.
    ``grain="row"`` averages over rental-payment rows, ``grain="customer"`` over
    the customers seen in the month and store. Averages have six digits.
    """
    rentals = shop.rental.where(
        (F.col("rental_date") >= F.lit(f"{year:04d}-01-01").cast("timestamp_ntz"))
        & (F.col("rental_date") < F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz"))
    ).select("rental_id", "customer_id", "rental_date", "inventory_id")
    stores = shop.inventory.select("inventory_id", "store_id")
    located = lookup_join(
        paid_rentals(shop, rentals, part=True), stores, "inventory_id"
    )
    # A customer is at most one row per month and store from here on.
    monthly = settle(
        located.groupBy(
            "customer_id", F.date_format("rental_date", "yyyy-MM").alias("month"), "store_id"
        ).agg(F.sum("paid").cast("decimal(28,2)").alias("paid"), F.sum("joined_rows").alias("joined_rows")),
        "store-months",
    )
    yearly = monthly.groupBy("customer_id").agg(F.sum("paid").alias("paid"))
    tiled = tiles(yearly, buckets, [F.asc("paid"), F.asc("customer_id")])
    middle = tiled.where(F.col("tile").between(low, high)).select("customer_id")
    kept = lookup_join(
        monthly, middle, "customer_id", "left_semi"
    )
    weight = F.sum("joined_rows") if grain == "row" else F.count(F.lit(1))
    return (
        kept.groupBy("month", "store_id")
        .agg(F.sum("paid").alias("paid"), weight.alias("weight"))
        .select("month", "store_id", round_ratio(cents(F.col("paid")), F.col("weight") * 100, DIGITS).alias("amount"))
        .orderBy("month", F.asc_nulls_last("store_id"))
    )
