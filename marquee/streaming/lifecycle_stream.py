"""The lifecycle kept current by streams of rental and payment files.

All that a batch changes lies in one store of keyed tables in hash buckets and is published as one version: the rentals
and payments so far, the lifecycle, the state, the tiers' bounds, and how far each stream has come. A batch that is run
again finds its number in the store and changes nothing; one that failed half way has left nothing visible.

A batch reads and rewrites the buckets of the customers it touches. Payments are told from their rental whose they are:
``owners`` gives the customer of a rental, and a payment that comes before its rental waits until that comes. Either
stream refreshes its customers, so the order of arrival does not matter.

Value tiers over all customers follow from counts of revenue ranges (``marquee.operators.kept_tiles``): the store keeps
the first customer of every tier, and readers derive a row's tier from them, so no row is rewritten for its tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.kept_tiles import BOUNDS, COUNTS, KeptTiles, tile_of
from marquee.operators.settle import passing, settle
from marquee.operators.skew import lookup_join
from marquee.plans.lifecycle import COLUMNS, SCHEMA, Lifecycle, Rules
from marquee.sources.buckets import BucketStore, Change, Keyed
from marquee.sources.shop import Shop
from marquee.streaming.state import ACTORS, TOTALS, State, collect_state, lifecycle_of, merge_state

VERSIONS = 3  # of the store that are kept for readers
BUCKETS = 64
MOST_PARTS = 16  # of a bucket of rentals or payments before they are put together
LONG, TEXT, TIME, MONEY = T.LongType(), T.StringType(), T.TimestampNTZType(), T.DecimalType(18, 2)
REQUIRED = ("rental_id", "customer_id", "stream", "batch_id")


def _columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name not in REQUIRED) for name, kind in kinds.items()])


OWNER = _columns(rental_id=LONG, customer_id=LONG)
PAYMENT = _columns(rental_id=LONG, customer_id=LONG, amount=MONEY, payment_date=TIME)
WAITING = _columns(rental_id=LONG, amount=MONEY, payment_date=TIME)
PROGRESS = _columns(stream=TEXT, batch_id=LONG, newest=TIME)


def rental_files(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A stream of the Parquet files of rentals, or of payments, that appear in ``folder``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class KeptLifecycle:
    """What readers see of the stream's store."""

    def __init__(self, store: BucketStore, all_tiers: bool):
        self.store, self.all_tiers = store, all_tiers

    def latest(self) -> int | None:
        return self.store.latest()

    def read(self, version: int | None = None, touching: DataFrame | None = None) -> DataFrame:
        """The lifecycle at a version, of all customers or of those in ``touching``."""
        version = self.latest() if version is None else version
        table = self.store.read("lifecycle", touching, version)
        if self.all_tiers:
            bounds = sorted(self.store.read("tiers", version=version).collect(), key=lambda r: r["tile"])  # a row per tier
            points = [(row["value"], row["id"]) for row in bounds]
            table = table.withColumn("value_tier", tile_of(points, F.col("thirty_days_revenue"), F.col("customer_id")))
        return table.select(*COLUMNS)


class LifecycleStream:
    """``shop`` gives every table but the rentals, which come from a stream, and with ``payments`` also but those.

    ``path`` receives the store and the streams' checkpoints. ``tier_scope`` ranks value tiers over the "batch" or over
    "all" customers. ``drop_late`` ignores rentals not newer than all earlier batches. ``stateful`` adds batches of
    rentals to a per-customer state instead of recomputing the history of touched customers; it knows no late payments.
    """

    def __init__(
        self,
        shop: Shop,
        path: str,
        rules: Rules = Rules(),
        tier_scope: str = "all",
        drop_late: bool = False,
        stateful: bool = False,
        payments: bool = False,
        buckets: int = BUCKETS,
    ):
        if stateful and payments:
            raise ValueError("the state adds rentals up as they are paid; payments that come later need the history")
        self.shop, self.spark, self.path, self.rules = shop, shop.spark, path, rules
        self.tier_scope, self.drop_late, self.stateful, self.payments = tier_scope, drop_late, stateful, payments
        self.store = BucketStore(self.spark, f"{path}/store", self._tables(buckets))
        self.lifecycle = KeptLifecycle(self.store, tier_scope == "all")
        self.sorted_rows = 0  # that the last batch sorted for the tiers

    def _tables(self, buckets: int) -> dict[str, Keyed]:
        customer, rental = ("customer_id",), ("rental_id",)
        copies = self.shop.inventory_core.schema["inventory_id"].dataType
        tables = {
            "rentals": Keyed(_columns(rental_id=LONG, rental_date=TIME, inventory_id=copies, customer_id=LONG), customer, buckets),
            "lifecycle": Keyed(SCHEMA, customer, buckets),
            "ranges": Keyed(COUNTS, ("range",), 1),
            "tiers": Keyed(BOUNDS, ("tile",), 1),
            "progress": Keyed(PROGRESS, ("stream",), 1),
        }
        if self.payments:
            tables |= {
                "owners": Keyed(OWNER, rental, buckets),
                "payments": Keyed(PAYMENT, customer, buckets),
                "waiting": Keyed(WAITING, rental, buckets),
            }
        if self.stateful:
            tables |= {"totals": Keyed(TOTALS, customer, buckets), "actors": Keyed(ACTORS, customer, buckets)}
        return tables

    # --- batches ---------------------------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of rentals; safe to run again with the same id."""
        self._process("rentals", batch, batch_id)

    def process_payments(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of payments; safe to run again with the same id."""
        self._process("payments", batch, batch_id)

    def _process(self, stream: str, batch: DataFrame, batch_id: int) -> None:
        change = self.store.change()
        done = {row["stream"]: row for row in change.read("progress").collect()}  # a row per stream
        last = done.get(stream)
        if last is not None and last["batch_id"] >= batch_id:
            return
        newest = last["newest"] if last is not None else None
        with passing(self.spark):
            if stream == "rentals":
                batch, newest = self._add_rentals(change, batch, newest)
            else:
                batch = self._add_payments(change, batch)
            progress = self.spark.createDataFrame([(stream, batch_id, newest)], PROGRESS)
            change.replace("progress", progress)
            self._refresh(change, batch)
            change.publish()
        self.store.keep_last(VERSIONS)

    def _add_rentals(self, change: Change, batch: DataFrame, newest) -> tuple[DataFrame, object]:
        batch = batch.select(*self.store.tables["rentals"].schema.names)
        if self.drop_late and newest is not None:
            batch = batch.where(F.col("rental_date") > F.lit(newest).cast("timestamp_ntz"))
        batch = change.append("rentals", batch)
        change.merge("rentals", MOST_PARTS)
        if self.payments:
            owners = batch.select(*OWNER.names)
            change.append("owners", owners)
            change.merge("owners", MOST_PARTS)
            come = lookup_join(change.read("waiting", owners), owners, "rental_id", "inner")
            come = change.append("payments", come.select(*PAYMENT.names))
            change.delete("waiting", come, ["rental_id"])
        latest = batch.agg(F.max("rental_date")).first()[0]
        return batch, max((d for d in (latest, newest) if d is not None), default=None)

    def _add_payments(self, change: Change, batch: DataFrame) -> DataFrame:
        """The payments whose rentals have come; the others wait for them."""
        batch = settle(batch.select(*WAITING.names), "batch")
        owners = settle(change.read("owners", batch), "owners")
        known = change.append("payments", lookup_join(batch, owners, "rental_id", "inner").select(*PAYMENT.names))
        change.merge("payments", MOST_PARTS)
        change.append("waiting", lookup_join(batch, owners.select("rental_id"), "rental_id", "left_anti"))
        change.merge("waiting", MOST_PARTS)
        return known

    def _refresh(self, change: Change, batch: DataFrame) -> None:
        """New lifecycle rows for the customers in ``batch``."""
        customers = settle(batch.select("customer_id").distinct(), "customers")
        rentals = change.read("rentals", customers)
        if self.payments:  # both are read once, where the rentals meet what was paid
            shop = self.shop.replace(rental=rentals, payment=change.read("payments", customers))
        else:  # the state reads again only the customers whose first date moved
            shop = self.shop.replace(rental=rentals if self.stateful else settle(rentals, "history"))
        if self.stateful:
            old = State(settle(change.read("totals", customers), "totals"), settle(change.read("actors", customers), "actors"))
            state = merge_state(old, shop, batch, self.rules).settled()
            change.replace("totals", state.totals, customers, settled=True)
            change.replace("actors", state.actors, customers, settled=True)
            rows = lifecycle_of(state, self.rules)
        else:
            rows = Lifecycle(shop, self.rules, part=not self.payments).table()
        rows = settle(rows, "refreshed")
        before = settle(change.read("lifecycle", customers), "before")
        change.replace("lifecycle", rows, customers, settled=True)
        if self.tier_scope == "all":
            self._keep_tiers(change, before, rows)

    def _keep_tiers(self, change: Change, before: DataFrame, after: DataFrame) -> None:
        def points(rows: DataFrame) -> DataFrame:
            return rows.select(F.col("thirty_days_revenue").alias("value"), F.col("customer_id").alias("id"))

        everyone, self.sorted_rows = points(change.read("lifecycle")), 0
        kept = KeptTiles.read(change.read("ranges"))
        kept = kept.changed(points(before), points(after))
        if kept.uneven() or len(kept.counts) == 1:
            kept = KeptTiles.cut(everyone)
            self.sorted_rows += sum(kept.counts)
        found, sorted_rows = kept.bounds(everyone, self.rules.tiers)
        self.sorted_rows += sorted_rows
        change.write("ranges", self.spark.createDataFrame(kept.rows(), COUNTS))
        change.write("tiers", self.spark.createDataFrame([(i, *point) for i, point in enumerate(found, 2)], BOUNDS))

    # --- streams ---------------------------------------------------------------------------------

    def start(self, rentals: DataFrame, every: str | None = None) -> StreamingQuery:
        """Process the rentals that are there now, or look for new files ``every`` interval ("1 hour")."""
        return self._start("rentals", rentals, self.process, every)

    def start_payments(self, payments: DataFrame, every: str | None = None) -> StreamingQuery:
        """The same for payments. The store has one writer: run the streams in turn."""
        return self._start("payments", payments, self.process_payments, every)

    def _start(self, name: str, rows: DataFrame, process, every: str | None) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(process).option("checkpointLocation", f"{self.path}/checkpoint/{name}")
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def run(self, rentals: DataFrame | None = None, payments: DataFrame | None = None) -> DataFrame:
        """Process what is there now, rentals first, and return the lifecycle."""
        if rentals is not None:
            self.start(rentals).awaitTermination()
        if payments is not None:
            self.start_payments(payments).awaitTermination()
        return self.lifecycle.read()
