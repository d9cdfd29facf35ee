"""Sales per category and store, kept current by signed changes.

The reports join payments, rentals, copies, films and categories. Here their sums are kept instead, and a change adds
what it makes them differ by: a row that comes counts once, one that goes counts minus once, an update is both. Because
every join is linear in each side, the difference of a join is the change of one side met with the other side as it was,
plus the new side met with the change of the other. So a payment is looked up in the rentals by its bucket, gives a
difference for a copy, that one for a film and store, and that for the film's categories. A film that moves takes its
sum along. Nothing else is read, and sums hold exact decimals, so they never drift.

Kept, in hash buckets that change together (``marquee.sources.buckets``): the copy of every rental, what was paid for it,
the categories of films, and the sums by film, category and store, each with the number of payments behind it: a group
without payments is no row of the report. Copies do not change hands; their films and stores are the shop's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.settle import passing, settle
from marquee.operators.skew import lookup_join
from marquee.plans.views import category_report, store_report
from marquee.sources.buckets import BucketStore, Change, Keyed
from marquee.sources.shop import Shop

MONEY, LONG = T.DecimalType(38, 2), T.LongType()
SUMS = ("paid", "payments")


def _sums(shop_schema: T.StructType, key: str) -> T.StructType:
    kind = shop_schema[key].dataType
    return T.StructType([T.StructField(key, kind, False), T.StructField("paid", MONEY), T.StructField("payments", LONG)])


class KeptSales:
    """The reports of a shop whose rentals, payments and film categories change."""

    def __init__(self, shop: Shop, path: str, buckets: int = 64):
        self.shop, self.spark = shop, shop.spark
        rental, copies, filed = shop.rental.select("rental_id", "inventory_id"), shop.inventory, shop.film_category
        held = T.StructType([T.StructField("rental_id", rental.schema["rental_id"].dataType, False), rental.schema["inventory_id"]])
        films = T.StructType([T.StructField("film_id", filed.schema["film_id"].dataType, False), filed.schema["category_id"]])
        self.store = BucketStore(
            self.spark,
            path,
            {
                "rentals": Keyed(held, ("rental_id",), buckets),
                "paid": Keyed(_sums(held, "rental_id"), ("rental_id",), buckets),
                "filed": Keyed(films, ("film_id",), buckets),
                "by_film": Keyed(_sums(copies.schema, "film_id"), ("film_id",), buckets),
                "by_category": Keyed(_sums(filed.schema, "category_id"), ("category_id",), 1),
                "by_store": Keyed(_sums(copies.schema, "store_id"), ("store_id",), 1),
            },
        )

    def change(
        self, rentals: DataFrame | None = None, payments: DataFrame | None = None, filed: DataFrame | None = None
    ) -> int:
        """Apply signed rows and publish the result as one version.

        ``rentals`` (rental_id, inventory_id, sign), ``payments`` (rental_id, amount, sign), ``filed`` (film_id,
        category_id, sign); sign is 1 for a row that comes and -1 for one that goes, as it was.
        """
        change = self.store.change()
        with passing(self.spark):
            copies = self._paid_copies(change, rentals, payments)
            self._add(change, "by_store", _summed(self._held(copies, "store_id"), "store_id"))
            films = lookup_join(self._held(copies, "film_id"), self.shop.film.select("film_id"), "film_id", "left_semi")
            by_film = settle(_summed(films, "film_id"), "film-changes")
            self._categories(change, by_film, filed)
            return change.publish()

    def start(self) -> int:
        """Take in the shop as it is."""
        rental, payment, filed = self.shop.rental, self.shop.payment_core, self.shop.film_category
        one = F.lit(1).alias("sign")
        return self.change(
            rental.select("rental_id", "inventory_id", one), payment.select("rental_id", "amount", one),
            filed.select("film_id", "category_id", one),
        )

    def _paid_copies(self, change: Change, rentals: DataFrame | None, payments: DataFrame | None) -> DataFrame:
        """(inventory_id, paid, payments): how the sums of copies differ."""
        nothing = self.spark.createDataFrame([], T.StructType([*self.store.tables["rentals"].schema.fields, T.StructField("sign", T.IntegerType())]))
        moved = settle(nothing if rentals is None else rentals, "rental-changes")
        found = [_times(lookup_join(moved, change.read("paid", moved), "rental_id", "inner"), "inventory_id")]
        change.replace("rentals", moved.where("sign > 0").select("rental_id", "inventory_id"), moved)
        if payments is not None:
            amount = F.coalesce("amount", F.lit(0)) * F.col("sign")
            sums = payments.groupBy("rental_id").agg(F.sum(amount).cast(MONEY).alias("paid"), F.sum("sign").cast("long").alias("payments"))
            sums = settle(sums.where(F.col("rental_id").isNotNull()), "payment-changes")
            met = lookup_join(sums, change.read("rentals", sums), "rental_id", "inner")
            found.append(met.select("inventory_id", *SUMS))
            self._add(change, "paid", sums)
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return settle(_summed(both, "inventory_id"), "copy-changes")

    def _held(self, copies: DataFrame, column: str) -> DataFrame:
        return lookup_join(copies, self.shop.inventory.select("inventory_id", column), "inventory_id", "inner").select(column, *SUMS)

    def _categories(self, change: Change, by_film: DataFrame, filed: DataFrame | None) -> None:
        found = _times(lookup_join(by_film, change.read("filed", by_film), "film_id", "inner").withColumn("sign", F.lit(1)), "category_id")
        self._add(change, "by_film", by_film)
        if filed is not None:
            moved = settle(filed.select("film_id", "category_id", "sign"), "filing-changes")
            found = found.unionByName(_times(lookup_join(moved, change.read("by_film", moved), "film_id", "inner"), "category_id"))
            found = settle(found, "category-changes")
            change.delete("filed", moved.where("sign < 0"), ["film_id", "category_id"])
            change.append("filed", moved.where("sign > 0").select("film_id", "category_id"))
        self._add(change, "by_category", _summed(found, "category_id"))

    def _add(self, change: Change, table: str, sums: DataFrame) -> None:
        """Add to the sums of some keys; those without a payment left go."""
        key = self.store.tables[table].key[0]
        sums = settle(sums.where(F.col(key).isNotNull()), "sum-changes")
        # The buckets are written anew, so all their sums are added up as they are: no key is looked for.
        buckets = self.store.buckets_of(table, sums)
        after = _summed(change.scan(table, buckets).select(key, *SUMS).unionByName(sums), key)
        change.put(table, after.where((F.col("payments") != 0) | (F.col("paid") != 0)), buckets)

    def by_category(self) -> DataFrame:
        """``views.sales_by_category`` of the shop as it is now."""
        return category_report(self.shop, self._totals("by_category"))

    def by_store(self) -> DataFrame:
        """``views.sales_by_store`` of the shop as it is now."""
        return store_report(self.shop, self._totals("by_store"))

    def _totals(self, table: str) -> DataFrame:
        return self.store.read(table).where(F.col("payments") > 0).drop("payments")


def _times(rows: DataFrame, key: str) -> DataFrame:
    """Sums with their sign."""
    return rows.select(key, *[(F.col(name) * F.col("sign")).alias(name) for name in SUMS])


def _summed(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum("paid").cast(MONEY).alias("paid"), F.sum("payments").cast("long").alias("payments"))


def signed(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The signed rows that lead from one table to another, rows counted."""
    one = before.select(*columns, F.lit(-1).alias("sign")).unionByName(after.select(*columns, F.lit(1).alias("sign")))
    net = one.groupBy(*columns).agg(F.sum("sign").cast("int").alias("net")).where(F.col("net") != 0)
    return net.select(*columns, F.signum("net").cast("int").alias("sign"), F.explode(F.sequence(F.lit(1), F.abs("net")))).drop("col")
