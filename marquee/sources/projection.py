"""The shop's tables as projections of an order-entry schema and an event feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.skew import lookup_join
from marquee.sources.shop import Shop

MONEY = "decimal(18,2)"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _person(name: str) -> list[Column]:
    """``Label#000000001`` as a first and a last name."""
    return [
        F.substring_index(name, "#", 1).alias("first_name"),
        F.substring_index(name, "#", -1).alias("last_name"),
    ]


class OrderProjection:
    """Orders are rentals, lines are payments, parts are films, suppliers act and manage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def lead_lines(self) -> DataFrame:
        """The first line of every order."""
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate"]
        return (
            self._read("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min(F.struct(*order)).alias("lead"))
            .select("l_orderkey", "lead.*")
        )

    def rental(self) -> DataFrame:
        orders, lead = self._read("orders"), self.lead_lines()
        return orders.join(lead, orders.o_orderkey == lead.l_orderkey, "left").select(
            F.col("o_orderkey").alias("rental_id"),
            F.col("o_orderdate").alias("rental_date"),
            F.col("l_orderkey").alias("inventory_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("return_date"),
            F.col("l_suppkey").alias("staff_id"),
        )

    def rental_core(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("rental_id"),
            F.col("o_orderdate").alias("rental_date"),
            F.col("o_custkey").alias("customer_id"),
        )

    def inventory(self) -> DataFrame:
        supplier = self._read("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_id")
        )
        return lookup_join(self.lead_lines(), supplier, "l_suppkey").select(
            F.col("l_orderkey").alias("inventory_id"), F.col("l_partkey").alias("film_id"), "store_id"
        )

    def inventory_core(self) -> DataFrame:
        return self.lead_lines().select(
            F.col("l_orderkey").alias("inventory_id"), F.col("l_partkey").alias("film_id")
        )

    def payment_core(self) -> DataFrame:
        return self._read("lineitem").select(
            F.col("l_orderkey").alias("rental_id"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            F.col("l_shipdate").alias("payment_date"),
        )

    def payment(self) -> DataFrame:
        # An order's lines may all be one order's: the lookup join spreads them.
        customers = self.rental_core().select("rental_id", "customer_id")
        return lookup_join(self.payment_core(), customers, "rental_id")

    def film(self) -> DataFrame:
        return self._read("part").select(
            F.col("p_partkey").alias("film_id"),
            F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("title"),
            F.col("p_brand").alias("description"),
            F.col("p_size").alias("rental_duration"),
            F.col("p_retailprice").cast(MONEY).alias("rental_rate"),
            F.col("p_size").alias("length"),
            F.col("p_retailprice").cast(MONEY).alias("replacement_cost"),
            F.col("p_brand").alias("rating"),
        )

    def category(self) -> DataFrame:
        return self._read("part").select(F.col("p_type").alias("category_id")).distinct().select(
            "category_id", F.col("category_id").alias("name")
        )

    def film_category(self) -> DataFrame:
        return self._read("part").select(
            F.col("p_partkey").alias("film_id"), F.col("p_type").alias("category_id")
        )

    def film_actor(self) -> DataFrame:
        return (
            self._read("lineitem")
            .select(F.col("l_suppkey").alias("actor_id"), F.col("l_partkey").alias("film_id"))
            .distinct()
        )

    def actor(self) -> DataFrame:
        return self._read("supplier").select(F.col("s_suppkey").alias("actor_id"), *_person("s_name"))

    def customer(self) -> DataFrame:
        return self._read("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_nationkey").alias("store_id"),
            *_person("c_name"),
            (F.col("c_custkey") * 2).alias("address_id"),
            (F.col("c_acctbal") >= 0).alias("activebool"),
        )

    def staff(self) -> DataFrame:
        return self._read("supplier").select(
            F.col("s_suppkey").alias("staff_id"),
            *_person("s_name"),
            (F.col("s_suppkey") * 2 + 1).alias("address_id"),
            F.col("s_nationkey").alias("store_id"),
        )

    def address(self) -> DataFrame:
        """Customers live at even ids, suppliers at odd ones."""

        def homes(owner: DataFrame, key: str, nation: str, street: Column, odd: int) -> DataFrame:
            return owner.select(
                (F.col(key) * 2 + odd).alias("address_id"),
                street.alias("address"),
                F.lpad(F.col(nation).cast("string"), 5, "0").alias("postal_code"),
                F.concat((F.col(nation) + 10).cast("string"), F.lit("-"), F.col(key).cast("string")).alias(
                    "phone"
                ),
                F.col(nation).alias("city_id"),
            )

        return homes(
            self._read("customer"), "c_custkey", "c_nationkey", F.col("c_mktsegment"), 0
        ).unionByName(homes(self._read("supplier"), "s_suppkey", "s_nationkey", F.col("s_name"), 1))

    def city(self) -> DataFrame:
        return self._read("nation").select(
            F.col("n_nationkey").alias("city_id"),
            F.col("n_name").alias("city"),
            F.col("n_regionkey").alias("country_id"),
        )

    def country(self) -> DataFrame:
        return self._read("region").select(
            F.col("r_regionkey").alias("country_id"), F.col("r_name").alias("country")
        )

    def store(self) -> DataFrame:
        return (
            self._read("supplier")
            .groupBy(F.col("s_nationkey").alias("store_id"))
            .agg(F.min("s_suppkey").alias("manager_staff_id"))
            .withColumn("address_id", F.col("manager_staff_id") * 2 + 1)
        )


class EventProjection:
    """The hourly feed: an event is a rental of the title named by its type, paid at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.events = read_table(spark, folder, "events")

    def rental(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("rental_id"),
            F.col("ts").alias("rental_date"),
            F.col("event_type").alias("inventory_id"),
            F.col("user_id").alias("customer_id"),
        )

    def payment(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("rental_id"),
            F.col("user_id").alias("customer_id"),
            F.col("value").cast(MONEY).alias("amount"),
            F.col("ts").alias("payment_date"),
        )

    def film(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("film_id")).distinct().select(
            "film_id", F.col("film_id").alias("title")
        )

    def inventory(self) -> DataFrame:
        return self.film().select(F.col("film_id").alias("inventory_id"), "film_id")

    def film_actor(self) -> DataFrame:
        return self.spark.createDataFrame([], "actor_id long, film_id string")

    def actor(self) -> DataFrame:
        return self.spark.createDataFrame([], "actor_id long, first_name string, last_name string")


ORDER_TABLES = (
    "rental rental_core inventory inventory_core payment payment_core film category film_category film_actor actor "
    "customer staff address city country store"
).split()

EVENT_TABLES = ("rental", "payment", "film", "inventory", "film_actor", "actor")


def shop_from_orders(spark: SparkSession, folder: str) -> Shop:
    source = OrderProjection(spark, folder)
    return Shop(spark, {name: getattr(source, name) for name in ORDER_TABLES})


def shop_from_events(spark: SparkSession, folder: str) -> Shop:
    source = EventProjection(spark, folder)
    return Shop(spark, {name: getattr(source, name) for name in EVENT_TABLES})
