"""Copies in and out of stock, for all copies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.sources.shop import Shop


def _open_rentals(shop: Shop) -> DataFrame:
    return shop.rental.where(F.col("return_date").isNull())


def inventory_in_stock(shop: Shop) -> DataFrame:
    """Every copy with ``in_stock``: never rented, or all its rentals returned."""
    out = _open_rentals(shop).groupBy("inventory_id").agg(F.count("rental_id").alias("out"))
    return shop.inventory.join(out, "inventory_id", "left").select(
        "inventory_id", "film_id", "store_id", (F.coalesce("out", F.lit(0)) == 0).alias("in_stock")
    )


def film_in_stock(shop: Shop) -> DataFrame:
    """Copies that can be rented; filter by film and store."""
    return inventory_in_stock(shop).where("in_stock").select("film_id", "store_id", "inventory_id")


def film_not_in_stock(shop: Shop) -> DataFrame:
    """Copies that are out; filter by film and store."""
    return inventory_in_stock(shop).where("not in_stock").select("film_id", "store_id", "inventory_id")


def stock_counts(shop: Shop) -> DataFrame:
    """Copies per film and store, in stock and out."""
    return inventory_in_stock(shop).groupBy("film_id", "store_id").agg(
        F.count_if("in_stock").alias("num_in_stock"), F.count_if(~F.col("in_stock")).alias("num_out")
    )


def inventory_held_by(shop: Shop) -> DataFrame:
    """The customer holding each copy that is out; the latest open rental decides."""
    return (
        _open_rentals(shop)
        .where(F.col("inventory_id").isNotNull())
        .groupBy("inventory_id")
        .agg(F.max_by("customer_id", F.struct("rental_date", "rental_id")).alias("customer_id"))
    )
