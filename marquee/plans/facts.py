"""Joins that several analyses share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import full_name
from marquee.operators.ranking import row_numbers
from marquee.operators.settle import settle
from marquee.operators.skew import lookup_join
from marquee.sources.shop import Shop


def payments_per_rental(shop: Shop, of: DataFrame | None = None) -> DataFrame:
    """Paid amount and number of payments of every paid rental, or of those in ``of``."""
    payments = shop.payment_core
    if of is not None:
        payments = lookup_join(payments, of.select("rental_id"), "rental_id", "left_semi")
    return payments.groupBy("rental_id").agg(
        F.sum(F.coalesce("amount", F.lit(0))).alias("paid"), F.count(F.lit(1)).alias("payments")
    )


def paid_rentals(shop: Shop, rentals: DataFrame, part: bool = False) -> DataFrame:
    """``rentals`` with ``paid`` (0 without payment) and ``joined_rows``.

    ``joined_rows`` is how many rows a rental has once joined to its payments,
    so sums, counts and averages over the joined rows need no fan-out. Both
    sides hold a rental once, so no key of this join is hot. ``part`` says that
    ``rentals`` are few of all: other payments are then dropped before they
    are summed.
    """
    sums = payments_per_rental(shop, rentals if part else None)
    joined = rentals.join(sums, "rental_id", "left")
    return joined.select(
        *rentals.columns,
        F.coalesce("paid", F.lit(0)).cast("decimal(28,2)").alias("paid"),
        F.coalesce("payments", F.lit(1)).alias("joined_rows"),
    )


def cast_names(shop: Shop, by: str = "name") -> DataFrame:
    """(film_id, actor_id, actor_name, appearances); ``by="name"`` merges namesakes
    and leaves ``actor_id`` empty."""
    actors = shop.actor.select("actor_id", full_name("first_name", "last_name").alias("actor_name"))
    cast = lookup_join(shop.film_actor.select("film_id", "actor_id"), actors, "actor_id")
    if by == "name":
        cast = cast.withColumn("actor_id", F.lit(None).cast(cast.schema["actor_id"].dataType))
    return cast.groupBy("film_id", "actor_id", "actor_name").agg(F.count(F.lit(1)).alias("appearances"))


NAMELESS = 2**63 - 1  # number of who has neither name nor id, behind all others
CAST_BLOCK = 512  # actors of a film in one row


def numbered_actors(shop: Shop, by: str = "name") -> DataFrame:
    """(actor_id, actor_name, records, number): actors in the order of name, then id; ``by="name"`` gives namesakes one
    number, and none to the nameless."""
    known = shop.actor.select("actor_id", full_name("first_name", "last_name").alias("actor_name"))
    if by != "name":
        known = lookup_join(shop.film_actor.select("actor_id").dropna().distinct(), known, "actor_id")
    records = known.groupBy("actor_id", "actor_name").agg(F.count(F.lit(1)).alias("records"))
    if by != "name":
        order = [F.asc_nulls_last("actor_name"), F.asc("actor_id")]
        return settle(row_numbers(records, order, name="number"), "actors")
    numbers = row_numbers(known.select("actor_name").dropna().distinct(), [F.asc("actor_name")], name="number")
    return settle(lookup_join(records, numbers, "actor_name"), "actors")


def cast_numbers(shop: Shop, actors: DataFrame) -> DataFrame:
    """(film_id, appearances, cast): the numbers of those who appear so often in a film, at most ``CAST_BLOCK`` a row."""
    films = shop.film_actor.select("film_id", "actor_id").where(F.col("film_id").isNotNull())
    cast = lookup_join(films, actors.select("actor_id", "records", "number"), "actor_id")
    number = F.coalesce("number", F.lit(NAMELESS)).alias("number")
    each = cast.repartition("film_id").groupBy("film_id", number).agg(F.sum(F.coalesce("records", F.lit(1))).alias("appearances"))
    place = F.row_number().over(Window.partitionBy("film_id").orderBy("number"))
    blocks = each.withColumn("block", F.call_function("div", place - 1, F.lit(CAST_BLOCK)))
    return blocks.groupBy("film_id", "block", "appearances").agg(F.collect_list("number").alias("cast")).drop("block")


def copy_titles(shop: Shop) -> DataFrame:
    """(film_id, inventory_id, title) of every copy."""
    return lookup_join(
        shop.inventory_core,
        shop.film.select("film_id", "title"),
        "film_id",
    )


def film_categories(shop: Shop) -> DataFrame:
    """(film_id, category) for every category a film is filed under."""
    names = shop.category.select("category_id", F.col("name").alias("category"))
    filed = shop.film_category.select("film_id", "category_id")
    return lookup_join(filed, names, "category_id").select("film_id", "category")


def places(shop: Shop) -> DataFrame:
    """Addresses with their city and country."""
    cities = lookup_join(shop.city, shop.country.select("country_id", "country"), "country_id", "inner")
    return lookup_join(shop.address, cities.select("city_id", "city", "country"), "city_id", "inner")
