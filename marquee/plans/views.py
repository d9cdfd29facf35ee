"""Reporting views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import compact_name, full_name, group_concat
from marquee.operators.skew import lookup_join
from marquee.plans.facts import payments_per_rental, places
from marquee.sources.shop import Shop


def actor_info(shop: Shop) -> DataFrame:
    """Per actor, ``Category: title, title`` of every category acted in.

    Actors without films keep a null list. One list cell holds at most an
    actor's films, so it is bounded by the catalogue and not by the rentals.
    """
    titles = shop.film.select("film_id", "title")
    names = shop.category.select("category_id", "name")
    filed = lookup_join(shop.film_category.select("film_id", "category_id"), titles, "film_id", "inner")
    filed = lookup_join(filed, names, "category_id", "inner")
    played = lookup_join(shop.film_actor.select("actor_id", "film_id"), filed, "film_id", "inner")
    per_category = played.groupBy("actor_id", "category_id", "name").agg(
        F.concat(F.col("name"), F.lit(": "), group_concat("title")).alias("entry")
    )
    lists = per_category.groupBy("actor_id").agg(group_concat("entry").alias("film_info"))
    return shop.actor.select("actor_id", "first_name", "last_name").join(lists, "actor_id", "left")


def actor_titles(shop: Shop) -> DataFrame:
    """What ``actor_info`` lists, as rows of actor, category and title; for catalogues whose lists outgrow a cell."""
    titles, names = shop.film.select("film_id", "title"), shop.category.select("category_id", F.col("name").alias("category"))
    filed = lookup_join(shop.film_category.select("film_id", "category_id"), titles, "film_id", "inner")
    filed = lookup_join(filed, names, "category_id", "inner")
    played = lookup_join(shop.film_actor.select("actor_id", "film_id"), filed, "film_id", "inner")
    return played.select("actor_id", "category", "title")


def film_actors(shop: Shop) -> DataFrame:
    """What ``film_list`` lists, as rows of film and actor."""
    actors = shop.actor.select("actor_id", full_name("first_name", "last_name").alias("actor_name"))
    return lookup_join(shop.film_actor.select("film_id", "actor_id"), actors, "actor_id", "inner").select("film_id", "actor_name")


def _address_list(shop: Shop, people: DataFrame) -> DataFrame:
    return lookup_join(people, places(shop), "address_id", "inner")


def customer_list(shop: Shop) -> DataFrame:
    return _address_list(shop, shop.customer).select(
        F.col("customer_id").alias("id"),
        full_name("first_name", "last_name").alias("name"),
        "address",
        F.col("postal_code").alias("zip code"),
        "phone",
        "city",
        "country",
        F.when(F.col("activebool"), "active").otherwise("").alias("notes"),
        F.col("store_id").alias("sid"),
    )


def staff_list(shop: Shop) -> DataFrame:
    return _address_list(shop, shop.staff).select(
        F.col("staff_id").alias("id"),
        full_name("first_name", "last_name").alias("name"),
        "address",
        F.col("postal_code").alias("zip code"),
        "phone",
        "city",
        "country",
        F.col("store_id").alias("sid"),
    )


def _film_list(shop: Shop, actor_name: Column) -> DataFrame:
    # Lists are built per film on ids alone; titles and categories join afterwards.
    actors = shop.actor.select("actor_id", actor_name.alias("actor_name"))
    cast = lookup_join(shop.film_actor.select("film_id", "actor_id"), actors, "actor_id", "inner")
    lists = cast.groupBy("film_id").agg(group_concat("actor_name").alias("actors"))
    names = shop.category.select("category_id", F.col("name").alias("category"))
    filed = lookup_join(shop.film_category.select("film_id", "category_id"), names, "category_id", "inner")
    films = shop.film.select(
        "film_id", "title", "description", F.col("rental_rate").alias("price"), "length", "rating"
    )
    return (
        films.join(filed, "film_id", "inner")
        .join(lists, "film_id", "inner")
        .select(
            F.col("film_id").alias("fid"),
            "title",
            "description",
            "category",
            "price",
            "length",
            "rating",
            "actors",
        )
    )


def film_list(shop: Shop) -> DataFrame:
    """Films with their category and cast; films without cast are left out."""
    return _film_list(shop, full_name("first_name", "last_name"))


def nicer_film_list(shop: Shop) -> DataFrame:
    """The film list with names capitalised and written without a blank."""
    return _film_list(shop, compact_name("first_name", "last_name"))


def _sales_per_copy(shop: Shop) -> DataFrame:
    rentals = shop.rental.select("rental_id", "inventory_id")
    return (
        rentals.join(payments_per_rental(shop), "rental_id", "inner")
        .groupBy("inventory_id")
        .agg(F.sum("paid").alias("paid"))
    )


def sales_by_category(shop: Shop) -> DataFrame:
    """Revenue per category, best first."""
    copies = shop.inventory_core
    per_film = (
        _sales_per_copy(shop)
        .join(copies, "inventory_id", "inner")
        .join(shop.film.select("film_id"), "film_id", "left_semi")
        .groupBy("film_id")
        .agg(F.sum("paid").alias("paid"))
    )
    filed = per_film.join(shop.film_category.select("film_id", "category_id"), "film_id", "inner")
    return category_report(shop, filed.groupBy("category_id").agg(F.sum("paid").alias("paid")))


def category_report(shop: Shop, per_category: DataFrame) -> DataFrame:
    """(category_id, paid) as the report, best first."""
    return (
        per_category.join(shop.category.select("category_id", "name"), "category_id", "inner")
        .groupBy(F.col("name").alias("category"))
        .agg(F.sum("paid").alias("total_sales"))
        .orderBy(F.desc("total_sales"), F.asc("category"))
    )


def sales_by_store(shop: Shop) -> DataFrame:
    """Revenue per store with its place and manager."""
    copies = shop.inventory.select("inventory_id", "store_id")
    per_store = (
        _sales_per_copy(shop)
        .join(copies, "inventory_id", "inner")
        .groupBy("store_id")
        .agg(F.sum("paid").alias("paid"))
    )
    return store_report(shop, per_store)


def store_report(shop: Shop, per_store: DataFrame) -> DataFrame:
    """(store_id, paid) as the report, with the store's place and manager."""
    stores = per_store.withColumnRenamed("paid", "total_sales").join(
        shop.store.select("store_id", F.col("manager_staff_id").alias("staff_id"), "address_id"),
        "store_id",
        "inner",
    )
    managers = shop.staff.select("staff_id", full_name("first_name", "last_name").alias("manager"))
    managed = lookup_join(stores, managers, "staff_id", "inner")
    return (
        lookup_join(managed, places(shop), "address_id", "inner")
        .orderBy("country", "city", "store_id")
        .select(F.concat("city", F.lit(","), "country").alias("store"), "manager", "total_sales")
    )
