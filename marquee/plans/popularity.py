"""Most rented titles of every category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import top_k
from marquee.plans.facts import film_categories
from marquee.sources.shop import Shop


def top_titles_by_category(shop: Shop, start: str, end: str, k: int = 10, by: str = "title") -> DataFrame:
    """The ``k`` most rented titles per category, rentals from ``start`` through ``end`` (dates).

    ``by="title"`` merges films of one title, ``by="film_id"`` keeps them apart.
    Rentals without film or category form their own groups. Equal counts are
    ordered by title.

    Rentals are counted per copy and per film before each join, so a popular
    copy or film is one row by then.
    """
    rented = shop.rental.where(
        (F.col("rental_date") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("rental_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    )
    per_copy = rented.groupBy("inventory_id").agg(F.count("customer_id").alias("n"))
    copies = shop.inventory_core
    per_film = per_copy.join(copies, "inventory_id", "left").groupBy("film_id").agg(F.sum("n").alias("n"))
    titled = per_film.join(shop.film.select("film_id", "title"), "film_id", "left").join(
        film_categories(shop), "film_id", "left"
    )
    group = ["category", "title"] + (["film_id"] if by == "film_id" else [])
    counted = titled.groupBy(*group).agg(F.sum("n").alias("num_of_rental"))
    order = [F.desc("num_of_rental"), F.asc_nulls_last("title")]
    if by == "film_id":
        order.append(F.asc_nulls_last("film_id"))
    best = top_k(counted, k, ["category"], order)
    return best.select(F.col("category").alias("category_name"), *group[1:], "num_of_rental")
