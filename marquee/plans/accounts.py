"""Customer balances and rewards."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.exact import MICROS_PER_DAY, micros_between
from marquee.operators.ranking import running_totals
from marquee.operators.skew import lookup_join
from marquee.sources.shop import Shop


def _charged(shop: Shop, rented: DataFrame) -> DataFrame:
    """``rented`` with the film's ``rental_rate``, the ``late_fee`` in units, and the ``replacement`` of films kept too long."""
    films = shop.film.select("film_id", "rental_rate", "rental_duration", "replacement_cost")
    copies = lookup_join(shop.inventory_core, films, "film_id", "inner")
    late = (
        micros_between(F.col("rental_date"), F.col("return_date"))
        - F.col("rental_duration").cast("long") * MICROS_PER_DAY
    )
    fee = F.when(late > 0, F.call_function("div", late, F.lit(MICROS_PER_DAY))).otherwise(0)
    kept = F.when(late > F.col("rental_duration").cast("long") * 2 * MICROS_PER_DAY, F.col("replacement_cost"))
    return lookup_join(rented, copies, "inventory_id", "inner").select(
        "customer_id", "rental_date", "rental_rate", fee.alias("late_fee"), F.coalesce(kept, F.lit(0)).alias("replacement")
    )


RENTED = ("rental_id", "customer_id", "inventory_id", "rental_date", "return_date")


def customer_balance(shop: Shop, as_of: str, replacement: bool = False) -> DataFrame:
    """What every customer owes at ``as_of``: rental fees plus late fees minus payments.

    A late rental costs one unit per whole day beyond its film's rental
    duration. ``replacement=True`` adds the replacement cost of films kept more
    than twice their duration beyond it.
    """
    until = F.lit(as_of).cast("timestamp_ntz")
    rented = shop.rental.where(F.col("rental_date") <= until).select(*RENTED)
    charges = (
        _charged(shop, rented)
        .groupBy("customer_id")
        .agg(
            F.sum("rental_rate").alias("fees"),
            F.sum("late_fee").alias("late_fees"),
            F.sum("replacement").alias("replacements"),
        )
    )
    paid = (
        shop.payment.where(F.col("payment_date") <= until)
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("paid"))
    )
    zero = F.lit(Decimal("0.00"))
    balance = (
        F.coalesce("fees", zero)
        + F.coalesce("late_fees", F.lit(0)).cast("decimal(20,0)")
        - F.coalesce("paid", zero)
    )
    if replacement:
        balance = balance + F.coalesce("replacements", zero)
    return (
        shop.customer.select("customer_id")
        .join(charges, "customer_id", "left")
        .join(paid, "customer_id", "left")
        .select("customer_id", balance.cast("decimal(38,2)").alias("balance"))
    )


def customer_balances(shop: Shop, asked: DataFrame, replacement: bool = False) -> DataFrame:
    """What customers owe at their own dates: ``asked`` (customer_id, as_of) -> customer_id, as_of, balance.

    Charges, payments and the dates asked for are one table in order of customer and time, with a running sum that is
    carried from task to task: no date meets the events before it, and a customer with very many is split. Each
    (customer, date) is answered once, for customers of the shop.
    """
    asked = asked.select("customer_id", F.col("as_of").cast("timestamp_ntz").alias("at")).where(F.col("as_of").isNotNull())
    asked = lookup_join(asked.distinct(), shop.customer.select("customer_id"), "customer_id", "left_semi")
    whose = asked.select("customer_id").distinct()
    charged = _charged(shop, lookup_join(shop.rental.select(*RENTED), whose, "customer_id", "left_semi"))
    money = F.col("rental_rate") + F.col("late_fee").cast("decimal(20,0)")
    if replacement:
        money = money + F.col("replacement")
    paid = lookup_join(shop.payment.select("customer_id", "payment_date", "amount"), whose, "customer_id", "left_semi")

    def events(df: DataFrame, at: str, amount: Column) -> DataFrame:
        rows = df.select("customer_id", F.col(at).alias("at"), amount.cast("decimal(38,2)").alias("amount"))
        sums = rows.where(F.col("at").isNotNull()).groupBy("customer_id", "at").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
        return sums.withColumn("asked", F.lit(False))

    probes = asked.withColumns({"amount": F.lit(0).cast("decimal(38,2)"), "asked": F.lit(True)})
    line = events(charged, "rental_date", money).unionByName(events(paid, "payment_date", -F.col("amount"))).unionByName(probes)
    # At one time charges and payments come before the question, as "up to and including" asks.
    order = [F.asc("at"), F.asc("asked"), F.asc("amount")]
    summed = running_totals(line, "amount", order, ["customer_id"], "balance").where(F.col("asked"))
    return summed.select("customer_id", F.col("at").alias("as_of"), F.col("balance").cast("decimal(38,2)").alias("balance"))


def rewards_report(shop: Shop, min_purchases: int, min_amount: float | Decimal, as_of: str) -> DataFrame:
    """Customers above both thresholds in the calendar month three months before ``as_of``."""
    if min_purchases <= 0:
        raise ValueError("min_purchases must be greater than 0")
    if min_amount <= 0:
        raise ValueError("min_amount must be greater than 0")
    month = F.trunc(F.add_months(F.lit(as_of).cast("date"), -3), "month")
    paid = F.col("payment_date")
    loyal = (
        shop.payment.where(
            (paid >= month.cast("timestamp_ntz")) & (paid < F.add_months(month, 1).cast("timestamp_ntz"))
        )
        .groupBy("customer_id")
        .agg(F.sum("amount").alias("spent"), F.count("customer_id").alias("purchases"))
        .where((F.col("spent") > F.lit(Decimal(str(min_amount)))) & (F.col("purchases") > min_purchases))
    )
    return shop.customer.join(loyal, "customer_id", "left_semi")
