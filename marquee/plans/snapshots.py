"""Snapshots of a table taken in by their differences.

A source that only gives whole snapshots is read once per snapshot; what is stored is not. For every hash bucket of the
key a digest of its rows is kept: two sums of row hashes and a count, which do not depend on the order of rows. Buckets
whose digests are the same are left alone, unread. Of the others, stored and new rows are compared by key: that gives the
change set, the stamps of rows that changed, and the only files that are written.

Equal digests stand for equal buckets: two different buckets would have to agree in 128 bits of sums and in their count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.settle import passing, settle
from marquee.sources.buckets import BucketStore, Keyed
from marquee.sources.versions import fit_schema

DIGESTS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("n", T.LongType()),
        T.StructField("a", T.DecimalType(38, 0)),
        T.StructField("b", T.DecimalType(38, 0)),
    ]
)


@dataclass(frozen=True)
class Taken:
    """What a snapshot has changed: the version, the buckets that differed, and (key, change) of every changed row."""

    version: int
    buckets: set[int]
    changes: DataFrame


class SnapshotTable:
    """A keyed table with a ``stamp`` column: when a row was last new or different. A key is held once."""

    def __init__(self, spark, path: str, table: Keyed, stamp: str = "last_update"):
        self.table, self.stamp = table, stamp
        self.store = BucketStore(spark, path, {"rows": table, "digests": Keyed(DIGESTS, ("bucket",), 1)})
        self.values = [name for name in table.schema.names if name != stamp]

    def read(self, touching: DataFrame | None = None, version: int | None = None) -> DataFrame:
        return self.store.read("rows", touching, version)

    def _digests(self, rows: DataFrame) -> DataFrame:
        values = [F.col(name) for name in self.values]
        # A null is marked: hashes of columns pass over it.
        marks = [F.col(name).isNull() for name in self.values]
        hashes = (F.xxhash64(*values, *marks), F.xxhash64(F.lit(1), *values, *marks))
        a, b = (F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)") for h in hashes)
        return rows.groupBy(self.table.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), a.alias("a"), b.alias("b"))

    def take(self, snapshot: DataFrame, as_of: Column) -> Taken:
        """Take in ``snapshot``, which has the table's columns but the stamp; ``as_of`` stamps what is new or different."""
        typed = T.StructType([f for f in self.table.schema.fields if f.name != self.stamp])
        change, key = self.store.change(), list(self.table.key)
        with passing(self.store.spark):
            new = settle(fit_schema(snapshot.select(*self.values), typed), "snapshot")
            digests = settle(self._digests(new), "digests")
            old = change.read("digests")
            both = digests.join(old.withColumnsRenamed({"n": "n_", "a": "a_", "b": "b_"}), "bucket", "full")
            same = F.struct("n", "a", "b").eqNullSafe(F.struct("n_", "a_", "b_"))
            differing = {row["bucket"] for row in both.where(~same).select("bucket").collect()}  # as many as buckets
            if not differing:
                change.publish()
                return Taken(change.version, set(), self._nothing())
            stored = change.scan("rows", differing)
            some = new.where(self.table.bucket().isin(sorted(differing)))
            compared = settle(self._compared(stored, some, as_of), "compared")
            change.put("rows", compared.where("`_change` <> 'gone'").select(*self.table.schema.names), differing)
            change.write("digests", digests)
            changes = settle(compared.where("`_change` <> 'same'").select(*key, F.col("_change").alias("change")), "changes", keep=True)
            change.publish()
            return Taken(change.version, differing, changes)

    def _nothing(self) -> DataFrame:
        fields = [self.table.schema[name] for name in self.table.key]
        return self.store.spark.createDataFrame([], T.StructType([*fields, T.StructField("change", T.StringType())]))

    def _compared(self, stored: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
        """Every row of either side with its stamp and ``_change``: same, new, different or gone."""
        key, values = list(self.table.key), [name for name in self.values if name not in self.table.key]
        was = stored.select(*key, F.struct(F.lit(True).alias("is"), *values).alias("_was"), F.col(self.stamp).alias("_stamp"))
        now = new.select(*key, F.struct(F.lit(True).alias("is"), *values).alias("_now"))
        both = was.join(now, key, "full")
        kind = (
            F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "gone")
            .when(F.col("_was").eqNullSafe(F.col("_now")), "same").otherwise("different")
        )
        stamp = F.when(kind.isin("same", "gone"), F.col("_stamp")).otherwise(as_of)
        found = F.coalesce("_now", "_was")
        return both.select(*key, *[found.getField(name).alias(name) for name in values], stamp.alias(self.stamp), kind.alias("_change"))
