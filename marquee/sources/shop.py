"""The rental shop's tables as lazily built DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from marquee.sources.catalog import TABLES

RENTAL_CORE = ("rental_id", "rental_date", "customer_id")
PAYMENT_CORE = ("rental_id", "amount", "payment_date")
INVENTORY_CORE = ("inventory_id", "film_id")


class Shop:
    """Named tables, each built when first asked for.

    ``rental_core``, ``payment_core`` and ``inventory_core`` are the columns of
    their tables that need fewest joins when the tables are projected from
    others; on stored tables they are plain column selections.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = dict(tables)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in self._builders:
            return self._builders[name]()
        if name == "rental_core":
            return self.rental.select(*RENTAL_CORE)
        if name == "payment_core":
            return self.payment.select(*PAYMENT_CORE)
        if name == "inventory_core":
            return self.inventory.select(*INVENTORY_CORE)
        raise AttributeError(f"the shop has no table {name!r}")

    def replace(self, **tables: DataFrame) -> Shop:
        """The same shop with some tables exchanged."""
        builders = dict(self._builders)
        for name in tables:
            builders.pop(f"{name}_core", None)
        builders.update({name: (lambda df=df: df) for name, df in tables.items()})
        return Shop(self.spark, builders)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Shop:
        """Tables stored as ``folder/<table>`` Parquet directories."""
        return cls(
            spark,
            {name: (lambda name=name: spark.read.parquet(f"{folder}/{name}")) for name in TABLES},
        )

    @classmethod
    def from_dump(cls, spark: SparkSession, files: Mapping[str, str]) -> Shop:
        """Tables read from tab-delimited dump files, given as table -> path."""
        from marquee.sources.dump_text import read_copy_table

        return cls(
            spark,
            {name: (lambda n=name, p=path: read_copy_table(spark, p, n)) for name, path in files.items()},
        )

    @classmethod
    def from_frames(cls, spark: SparkSession, **tables: DataFrame) -> Shop:
        return cls(spark, {name: (lambda df=df: df) for name, df in tables.items()})
