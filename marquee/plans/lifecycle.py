"""One row per customer: first and last film, value, tier, favourite actors, growth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.exact import MICROS_PER_DAY, cents, micros_between, round_ratio
from marquee.operators.ranking import tiles, top_k
from marquee.operators.settle import settle
from marquee.operators.skew import lookup_join
from marquee.plans.facts import NAMELESS, cast_names, cast_numbers, numbered_actors, paid_rentals
from marquee.sources.shop import Shop

SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("first_rent_date", T.TimestampNTZType(), False),
        T.StructField("thirty_days_date", T.TimestampNTZType(), False),
        T.StructField("thirty_days_revenue", T.DecimalType(20, 5), False),
        T.StructField("value_tier", T.IntegerType(), False),
        T.StructField("first_film", T.StringType()),
        T.StructField("latest_film", T.StringType()),
        T.StructField("last_rental_date", T.TimestampNTZType()),
        T.StructField("avg_time_days_between_rental", T.DecimalType(10, 2)),
        T.StructField("total_revenue", T.DecimalType(20, 5), False),
        T.StructField("fav_actor_one", T.StringType()),
        T.StructField("fav_actor_two", T.StringType()),
        T.StructField("fav_actor_three", T.StringType()),
        T.StructField("revenue_growth_rate", T.DecimalType(20, 5)),
    ]
)
COLUMNS = SCHEMA.names
HEAVY = 4096  # films of a customer above which they are dealt over tasks
PAIRS = 500_000  # of customers and actors that a task counts


@dataclass(frozen=True)
class Rules:
    """How the lifecycle reads its columns.

    first_days: length of the opening period in days.
    tiers: number of value tiers, 1 being the best.
    single_rental: "null" leaves first and last film of one-time renters empty,
        "same" gives the one film as both.
    denominator: "rows" divides a customer's time span by rental-payment rows,
        "rentals" by distinct rentals, "gaps" by the gaps between rentals.
    extremes: "chronological" takes first and last by date, then id; "by_id"
        takes the lowest and highest id among rentals at either extreme date.
    actors_by: "name" or "actor_id", what counts as one actor.
    """

    first_days: int = 30
    tiers: int = 10
    single_rental: str = "null"
    denominator: str = "rows"
    extremes: str = "chronological"
    actors_by: str = "name"


def period_end(rules: Rules, first: str = "first_rent_date") -> Column:
    return F.col(first) + F.expr(f"INTERVAL '{rules.first_days}' DAY")


def average_gap(rules: Rules) -> Column:
    """Days between first and last rental over the rules' count, two digits."""
    if rules.denominator == "rows":
        count = F.col("num_of_rentals")
    elif rules.denominator == "rentals":
        count = F.col("num_distinct_rentals")
    else:
        count = F.col("num_distinct_rentals") - 1
    span = micros_between(F.col("first_rental_date"), F.col("last_rental_date"))
    return round_ratio(span, count.cast("decimal(20,0)") * MICROS_PER_DAY, 2)


def growth(rules: Rules) -> Column:
    """Change of revenue per day after the opening period against within it, in percent.

    Without opening revenue it is the revenue per day afterwards, times 100.
    Null when the last rental is exactly at the end of the period.
    """
    early = cents(F.col("thirty_days_revenue"))
    late = cents(F.col("total_revenue")) - early
    after = micros_between(F.col("thirty_days_date"), F.col("last_rental_date")).cast("decimal(38,0)")
    period = F.lit(MICROS_PER_DAY * rules.first_days).cast("decimal(38,0)")
    # late/after against early/period, both per microsecond, as one fraction
    relative = round_ratio((late * period - early * after) * 100, early * after, 2)
    absolute = round_ratio(late * MICROS_PER_DAY, after, 2)
    return F.when(early == 0, absolute).otherwise(relative)


def watched_actors(shop: Shop, watched: DataFrame, rules: Rules) -> DataFrame:
    """Appearances per customer and actor from (customer_id, film_id, times).

    Rentals of films without cast count as a nameless actor.
    """
    cast = cast_names(shop, rules.actors_by)
    return (
        lookup_join(watched, cast, "film_id")
        .groupBy("customer_id", "actor_id", "actor_name")
        .agg(F.sum(F.col("times") * F.coalesce("appearances", F.lit(1))).alias("seen"))
    )


def three_favourites(seen: DataFrame) -> DataFrame:
    """The three most seen actors of every customer as columns, ties by name."""
    order = [F.desc("seen"), F.asc_nulls_last("actor_name"), F.asc_nulls_last("actor_id")]
    return _three(top_k(seen, 3, ["customer_id"], order))


def _three(best: DataFrame) -> DataFrame:
    places = ((1, "one"), (2, "two"), (3, "three"))
    return best.groupBy("customer_id").agg(
        *[
            F.max(F.when(F.col("place") == place, F.col("actor_name"))).alias(f"fav_actor_{word}")
            for place, word in places
        ]
    )


def favourite_actors(shop: Shop, watched: DataFrame, rules: Rules) -> DataFrame:
    """``three_favourites`` of ``watched_actors``, from (customer_id, film_id, times).

    Customers times the casts of their films are many more rows than there are rentals. So films come to their customer
    with the cast as a list of numbers, and only there it is spread out, counted, and cut to three; names come last.
    Customers with very many films are counted by pairs of customer and actor instead.
    """
    actors = numbered_actors(shop, rules.actors_by)
    records = shop.film.groupBy("film_id").agg(F.count(F.lit(1)).alias("records"))
    # As with the titles, a film that is recorded twice counts twice.
    casts = cast_numbers(shop, actors).join(records, "film_id", "full").where(F.col("film_id").isNotNull()).select(
        "film_id",
        (F.coalesce("appearances", F.lit(1)) * F.coalesce("records", F.lit(1))).alias("appearances"),
        F.coalesce("cast", F.array(F.lit(NAMELESS))).alias("cast"),
    )
    casts = settle(casts, "casts")
    watched = settle(watched, "watched-films")
    films = watched.groupBy("customer_id").agg(F.count(F.lit(1)).alias("films"))
    heavy = settle(films.where((F.col("films") > HEAVY) | F.col("customer_id").isNull()).select("customer_id"), "heavy")
    sizes = casts.agg(F.sum(F.size("cast")).alias("actors"), F.count_distinct("film_id").alias("films")).first()
    pairs = watched.count() * max((sizes["actors"] or 0) / max(sizes["films"], 1), 1)
    tasks = int(pairs // PAIRS) + 1

    def counted(films: DataFrame, together: bool) -> DataFrame:
        met = lookup_join(films, casts, "film_id").select(
            "customer_id",
            (F.col("times") * F.coalesce("appearances", F.lit(1))).alias("times"),
            F.coalesce("cast", F.array(F.lit(NAMELESS))).alias("cast"),
        )
        met = met.repartition(tasks, "customer_id") if together else met
        each = met.select("customer_id", "times", F.explode("cast").alias("number"))
        return each.groupBy("customer_id", "number").agg(F.sum("times").alias("seen"))

    order = [F.desc("seen"), F.asc("number")]
    best = top_k(counted(watched.join(heavy, "customer_id", "left_anti").dropna(subset=["customer_id"]), True), 3, ["customer_id"], order)
    if not heavy.isEmpty():
        many = watched.join(heavy, watched["customer_id"].eqNullSafe(heavy["customer_id"]), "left_semi")
        best = best.unionByName(top_k(counted(many, False), 3, ["customer_id"], order))
    return _three(lookup_join(best, actors.select("number", "actor_name").dropna(subset=["number"]).distinct(), "number"))


class Lifecycle:
    """The lifecycle table and its parts over one shop.

    Rentals are joined to their payments once and settled; every part reads
    the columns it needs from there. A customer is one row after the first
    aggregation, and steps that go back to rentals use the skew-aware join.
    """

    def __init__(self, shop: Shop, rules: Rules = Rules(), part: bool = False):
        """``part`` says that the shop's rentals are few of those its payments are for."""
        self.shop = shop
        self.rules = rules
        self.part = part

    @cached_property
    def facts(self) -> DataFrame:
        """(rental_id, customer_id, rental_date, inventory_id, paid, joined_rows)."""
        rentals = self.shop.rental.select("rental_id", "customer_id", "rental_date", "inventory_id")
        return settle(paid_rentals(self.shop, rentals, self.part), "paid-rentals")

    @cached_property
    def spans(self) -> DataFrame:
        """Dates, revenue, counts, and the first and last rental of every customer; one pass over the rentals."""
        rental = F.struct("rental_date", "rental_id", "inventory_id")
        spans = self.facts.groupBy("customer_id").agg(
            F.min(rental).alias("a"),
            F.max(rental).alias("b"),
            F.min("rental_date").alias("first_rent_date"),
            F.max("rental_date").alias("last_rent_date"),
            F.sum("paid").cast("decimal(28,2)").alias("total_revenue"),
            F.sum("joined_rows").alias("num_of_rentals"),
            F.count(F.lit(1)).alias("num_distinct_rentals"),
        )
        return settle(spans, "spans")

    @cached_property
    def copies(self) -> DataFrame:
        """(film_id, inventory_id), read by the actors and the titles."""
        return settle(self.shop.inventory_core.select("film_id", "inventory_id"), "copies")

    def total_revenue(self) -> DataFrame:
        return self.spans.select("customer_id", "total_revenue", "num_of_rentals")

    def first_period(self) -> DataFrame:
        """First rental date and end of the opening period."""
        return (
            self.shop.rental_core.groupBy("customer_id")
            .agg(F.min("rental_date").alias("first_rent_date"))
            .withColumn("thirty_days_date", period_end(self.rules))
        )

    @cached_property
    def period_revenue(self) -> DataFrame:
        """Revenue of the opening period and the value tier it gives."""
        periods = self.spans.select("customer_id", period_end(self.rules).alias("thirty_days_date"))
        rentals = self.facts.select("rental_id", "customer_id", "rental_date", "paid")
        early = lookup_join(rentals, periods, "customer_id", "inner").where(
            F.col("rental_date") < F.col("thirty_days_date")
        )
        revenue = early.groupBy("customer_id").agg(
            F.sum("paid").cast("decimal(28,2)").alias("thirty_days_revenue")
        )
        return tiles(
            revenue, self.rules.tiers, [F.desc("thirty_days_revenue"), F.asc("customer_id")], "value_tier"
        )

    def fav_three_actors(self) -> DataFrame:
        """The three actors seen most per customer, in three columns."""
        rentals = self.facts.select("rental_id", "customer_id", "inventory_id")
        copies = self.copies.select("inventory_id", "film_id")
        watched = (
            lookup_join(rentals, copies, "inventory_id")
            .groupBy("customer_id", "film_id")
            .agg(F.count("rental_id").alias("times"))
        )
        return favourite_actors(self.shop, watched, self.rules)

    def _ends(self) -> DataFrame:
        """First and last rental of every customer as structs ``a`` and ``b``."""
        if self.rules.extremes == "chronological":
            return self.spans.select("customer_id", "a", "b")
        dates = self.spans.select("customer_id", "first_rent_date", "last_rent_date")
        rentals = self.facts.select("rental_id", "customer_id", "rental_date", "inventory_id")
        at_ends = lookup_join(rentals, dates, "customer_id", "inner").where(
            (F.col("rental_date") == F.col("first_rent_date"))
            | (F.col("rental_date") == F.col("last_rent_date"))
        )
        by_id = F.struct("rental_id", "rental_date", "inventory_id")
        ends = at_ends.groupBy("customer_id").agg(F.min(by_id).alias("x"), F.max(by_id).alias("y"))
        fields = ("rental_date", "rental_id", "inventory_id")
        x, y = (F.struct(*[F.col(f"{end}.{f}").alias(f) for f in fields]) for end in ("x", "y"))
        return ends.select("customer_id", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    @cached_property
    def first_latest_film(self) -> DataFrame:
        """Titles and dates of the first and the last rental.

        Customers whose last film has no title are left out, and one-time
        renters too unless the rules say otherwise.
        """
        ends = self._ends()
        if self.rules.single_rental == "null":
            ends = ends.where(F.col("a.rental_id") != F.col("b.rental_id"))
        # Both ends go through one title lookup and come back as columns.
        marked = ends.select(
            "customer_id",
            F.inline(
                F.array(
                    F.struct(F.lit(True).alias("is_first"), F.col("a").alias("end")),
                    F.struct(F.lit(False).alias("is_first"), F.col("b").alias("end")),
                )
            ),
        ).select("customer_id", "is_first", "end.rental_date", "end.inventory_id")
        titles = self.shop.film.select("film_id", "title")
        titled = lookup_join(lookup_join(marked, self.copies, "inventory_id"), titles, "film_id")

        def pick(first: bool, column: str) -> Column:
            chosen = F.col("is_first") if first else ~F.col("is_first")
            return F.max(F.when(chosen, F.col(column)))

        return (
            titled.groupBy("customer_id")
            .agg(
                pick(True, "rental_date").alias("first_rental_date"),
                pick(True, "title").alias("first_film"),
                pick(False, "rental_date").alias("last_rental_date"),
                pick(False, "title").alias("latest_film"),
            )
            .where(F.col("latest_film").isNotNull())
        )

    def avg_rental_time(self) -> DataFrame:
        return (
            self.spans.join(self.first_latest_film, "customer_id", "left")
            .select("customer_id", average_gap(self.rules).alias("avg_time_days_between_rental"))
        )

    def revenue_growth_rate(self) -> DataFrame:
        return self._assembled().select("customer_id", growth(self.rules).alias("revenue_growth_rate"))

    def _assembled(self) -> DataFrame:
        return (
            self.spans.drop("a", "b").withColumn("thirty_days_date", period_end(self.rules))
            .join(self.period_revenue, "customer_id", "left")
            .join(self.first_latest_film, "customer_id", "left")
        )

    def table(self) -> DataFrame:
        """The lifecycle, one row per customer."""
        return (
            self._assembled()
            .join(self.fav_three_actors(), "customer_id", "left")
            .withColumn("avg_time_days_between_rental", average_gap(self.rules))
            .withColumn("revenue_growth_rate", growth(self.rules))
            .select(*COLUMNS)
        )


def customer_lifecycle(shop: Shop, rules: Rules = Rules()) -> DataFrame:
    return Lifecycle(shop, rules).table()
