"""Every registered query: a callable from (spark, folder) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.text import group_concat, last_day
from marquee.operators import quality
from marquee.operators.changes import fill_defaults, stamp_changes
from marquee.operators.postings import match_all_terms, token_index
from marquee.operators.ranking import assign_ids, row_numbers, tiles
from marquee.operators.settle import scratch_path, settle
from marquee.plans import accounts, incremental, lifecycle, recommend, stock, views
from marquee.plans.kept_index import KeptIndex
from marquee.plans.kept_sales import KeptSales, signed
from marquee.plans.lifecycle import Lifecycle, Rules, customer_lifecycle
from marquee.plans.popularity import top_titles_by_category
from marquee.plans.recommend import Recommendations, item_recommendations
from marquee.plans.search import film_index
from marquee.plans.snapshots import SnapshotTable, Taken
from marquee.plans.store_value import mid_value_store_month
from marquee.sources.buckets import BucketStore, Keyed
from marquee.sources.catalog import define_table
from marquee.sources.dump_text import copy_lines, read_copy_text
from marquee.sources.load import load_shop, with_table_defaults
from marquee.sources.projection import (
    EventProjection,
    read_table,
    shop_from_events,
    shop_from_orders,
)
from marquee.sources.versions import VersionedTable, fit_schema
from marquee.streaming.lifecycle_stream import LifecycleStream, rental_files

Query = Callable[[SparkSession, str], DataFrame]

START, END, YEAR = "1998-01-01", "1998-06-30", 1998
MARK = "2001-06-01 00:00:00"
BALANCE_DATE = "1998-12-31 00:00:00"
REWARDS_DATE, REWARDS_PURCHASES, REWARDS_AMOUNT = "1998-08-15", 3, 50000
SEARCH = ["ed", "er"]
PERIODS = 3  # equal parts of the events' time
EVENT_RULES = Rules(first_days=7)
OTHER_RULES = Rules(single_rental="same", denominator="gaps", actors_by="actor_id")

DOCUMENTS = define_table(
    "doc_id", "doc_id long!, text text!, lang text!, source text!, n_chars long!"
)

TYPED = define_table(
    "id",
    "id long!, done bool, day date, at time, fee money, status char(4), raw bytes, notes texts, words tokens, remark text",
)


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the last step before comparison."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _orders(build: Callable) -> Query:
    """A query over the shop projected from the order tables."""
    return lambda spark, folder: plain(build(shop_from_orders(spark, folder)))


def _table(spark: SparkSession, label: str) -> VersionedTable:
    return VersionedTable(spark, scratch_path(spark, label))


def _store(spark: SparkSession, name: str, table: Keyed) -> BucketStore:
    return BucketStore(spark, scratch_path(spark, name), {name: table})


# --- increment -------------------------------------------------------------------------------


def _mark() -> incremental.Mark:
    return incremental.Mark(MARK)


def _old_lifecycle(shop) -> DataFrame:
    known = shop.rental.where(F.col("rental_date") <= F.lit(MARK).cast("timestamp_ntz"))
    return customer_lifecycle(shop.replace(rental=known))


def _increment(shop) -> DataFrame:
    return incremental.lifecycle_increment(shop, incremental.new_rentals(shop.rental, _mark()))


def _saved_mark(shop) -> DataFrame:
    control = _table(shop.spark, "mark")
    incremental.save_mark(shop.rental_core, control)
    return control.read()


def _staging(shop) -> DataFrame:
    return incremental.with_history(
        shop.rental_core, incremental.new_rentals(shop.rental_core, _mark())
    )


def _staging_twice(shop) -> DataFrame:
    # Staged rentals met by their new part once more: the new ones are duplicates.
    new = incremental.new_rentals(shop.rental, _mark())
    return incremental.staging_duplicates(incremental.with_history(shop.rental, new).unionByName(new))


# --- streams ---------------------------------------------------------------------------------


def _stream(order: tuple[int, ...], **options) -> Query:
    """Events arrive period by period; the stream is restarted for each arrival."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, "stream")
        rentals = EventProjection(spark, folder).rental()
        stream = LifecycleStream(shop_from_events(spark, folder), path, EVENT_RULES, buckets=16, **options)
        period = _period(spark, folder, "rental_date")
        for at in order:
            rentals.where(period == at).write.mode("append").parquet(f"{path}/inbox")
            stream.run(rental_files(spark, f"{path}/inbox", rentals.schema))
        return plain(stream.lifecycle.read())

    return run


def _period(spark: SparkSession, folder: str, date: str, parts: int = PERIODS) -> Column:
    """Which of the equal parts of the events' time a date is in."""
    first, last = read_table(spark, folder, "events").agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * at // parts for at in range(1, parts)]
    period = F.lit(0)
    for cut in cuts:
        period = period + (F.col(date) >= F.lit(cut).cast("timestamp_ntz")).cast("int")
    return F.coalesce(period, F.lit(0))


def _two_streams(arrivals: tuple[str, ...]) -> Query:
    """Rentals and payments are two feeds; ``r0`` is the arrival of the rentals of the first half, ``p0`` of its payments."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path, events = scratch_path(spark, "stream"), EventProjection(spark, folder)
        shop = shop_from_events(spark, folder).replace(payment=None)
        stream = LifecycleStream(shop, path, EVENT_RULES, payments=True, buckets=16)
        feeds = {"r": (events.rental(), "rental_date"), "p": (events.payment(), "payment_date")}
        for kind, at in arrivals:
            rows, date = feeds[kind]
            inbox = f"{path}/inbox-{kind}"
            rows.where(_period(spark, folder, date, parts=2) == int(at)).write.mode("append").parquet(inbox)
            files = rental_files(spark, inbox, rows.schema)
            stream.run(rentals=files) if kind == "r" else stream.run(payments=files)
        return plain(stream.lifecycle.read())

    return run


# --- tables ----------------------------------------------------------------------------------


def _written(shop) -> DataFrame:
    table = _table(shop.spark, "recommendations")
    table.write(item_recommendations(shop), recommend.SCHEMA)
    return table.read()


def _published(shop) -> DataFrame:
    """The lifecycle before the mark, then its update in the buckets of its customers, as two versions."""
    store = _store(shop.spark, "lifecycle", Keyed(lifecycle.SCHEMA, ("customer_id",), 64))
    change = store.change()
    change.write("lifecycle", _old_lifecycle(shop))
    change.publish()
    change = store.change()
    incremental.publish_increment(change, settle(fit_schema(_increment(shop), lifecycle.SCHEMA), "increment"))
    change.publish()
    return store.read("lifecycle")


def _appended(spark: SparkSession, folder: str) -> DataFrame:
    """Three appends, put together at the end."""
    table = _table(spark, "orders")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    for status in "FOP":
        table.append(orders.where(F.col("o_orderstatus") == status))
    table.merge(most=2)
    return table.read()


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customer; those of blocked customers go, with their buckets rewritten."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    store = _store(spark, "orders", Keyed(orders.schema, ("o_custkey",), 64))
    change = store.change()
    change.write("orders", orders)
    change.publish()
    blocked = read_table(spark, folder, "customer").where("c_acctbal < 0")
    change = store.change()
    change.delete("orders", blocked.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    change.publish()
    return store.read("orders")


# --- kept results -----------------------------------------------------------------------------


def _kept_sales(shop) -> KeptSales:
    """Sales of the time before the mark with wrong amounts and films filed elsewhere; then everything is put right."""
    mark = F.lit(MARK).cast("timestamp_ntz")
    rentals = shop.rental.select("rental_id", "inventory_id", "rental_date")
    payments = shop.payment_core.select("rental_id", "amount", "payment_date")
    filed = shop.film_category.select("film_id", "category_id")
    wrong = F.when(F.col("amount") > 50000, F.col("amount") * 2).otherwise(F.col("amount")).cast("decimal(18,2)")
    first = filed.agg(F.min("category_id")).first()[0]
    old_rentals = rentals.where(F.col("rental_date") <= mark)
    old_payments = payments.where(F.col("payment_date") <= mark).withColumn("amount", wrong)
    old_filed = filed.withColumn("category_id", F.when(F.col("category_id") < "M", F.lit(first)).otherwise(F.col("category_id")))
    before = shop.replace(rental=old_rentals, payment=old_payments, film_category=old_filed)
    kept = KeptSales(before, scratch_path(shop.spark, "sales"), buckets=16)
    kept.start()
    kept.change(payments=signed(old_payments, payments, ["rental_id", "amount"]))
    kept.change(signed(old_rentals, rentals, ["rental_id", "inventory_id"]), filed=signed(old_filed, filed, ["film_id", "category_id"]))
    return kept


def _kept_index(spark: SparkSession, folder: str) -> KeptIndex:
    """Documents whose texts were their sources at first, and one too many; then each gets its text."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    index = KeptIndex(spark, scratch_path(spark, "index"), buckets=32)
    extra = documents.agg((F.max("doc_id") + 1).alias("doc_id"), F.lit("ed er").alias("text"))
    index.update(documents.select("doc_id", F.concat_ws(" ", "source", F.lit("ed er")).alias("text")).unionByName(extra))
    index.update(documents.select("doc_id", "text"), gone=extra)
    return index


def _snapshots(shop) -> tuple[SnapshotTable, Taken]:
    """Films, and the same with raised rates."""
    at, later = (F.lit(f"{day} 00:00:00").cast("timestamp_ntz") for day in ("2006-02-15", "2006-03-01"))
    old = shop.film.select("film_id", "title", "rental_rate")
    raised = F.when(F.length("title") > 14, F.col("rental_rate") + 1).otherwise(F.col("rental_rate")).cast("decimal(18,2)")
    films = old.withColumn("last_update", at)
    table = SnapshotTable(shop.spark, scratch_path(shop.spark, "films"), Keyed(films.schema, ("film_id",), 32))
    table.take(old, at)
    return table, table.take(old.withColumn("rental_rate", raised), later)


def _balances(shop) -> DataFrame:
    """What customers owe at the end of every month in which they rented."""
    asked = shop.rental_core.select("customer_id", last_day("rental_date").cast("timestamp_ntz").alias("as_of"))
    return accounts.customer_balances(shop, asked, replacement=True)


def _dump_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "dump")
    documents = read_table(spark, folder, "documents").select(*DOCUMENTS.schema.names)
    copy_lines(documents).write.text(path)
    return read_copy_text(spark, path, DOCUMENTS)


# --- single operators ------------------------------------------------------------------------


def _order_tiles(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    tiled = tiles(orders, 10, [F.asc("o_totalprice"), F.asc("o_orderkey")])
    return tiled.select("o_orderkey", "tile")


def _event_ids(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id")
    return assign_ids(events, [F.asc("user_id"), F.asc("ts"), F.asc("event_id")], start=1000)


def _event_ranks(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").select("event_type", "value", "event_id")
    return row_numbers(events, [F.desc("value"), F.asc("event_id")], within=["event_type"])


def _event_types(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return events.groupBy("user_id").agg(group_concat("event_type", distinct=True).alias("event_types"))


def _month_ends(shop) -> DataFrame:
    return shop.rental_core.select("rental_id", last_day("rental_date").alias("month_end"))


def _stamped(shop) -> DataFrame:
    at = F.lit("2006-02-15 00:00:00").cast("timestamp_ntz")
    old = shop.film.select("film_id", "title", "rental_rate", at.alias("last_update"))
    raised = (F.col("rental_rate") + 1).cast("decimal(18,2)")
    new = old.withColumn(
        "rental_rate", F.when(F.length("title") > 14, raised).otherwise(F.col("rental_rate"))
    )
    return stamp_changes(old, new, ["film_id"], F.lit("2006-03-01 00:00:00").cast("timestamp_ntz"))


def _defaulted(shop) -> DataFrame:
    rentals = shop.rental.select("rental_id", "inventory_id", "return_date")
    return fill_defaults(rentals, {"inventory_id": F.lit(-1), "return_date": F.lit("2002-01-01")})


def _table_defaults(shop) -> DataFrame:
    """Films whose short terms are missing, filled by the table's declared defaults."""
    at = F.lit("2006-02-15 00:00:00").cast("timestamp_ntz")
    films = shop.film.select(
        "film_id",
        F.when(F.col("film_id") % 3 != 0, F.col("rental_duration")).alias("rental_duration"),
        F.when(F.col("film_id") % 4 != 0, F.col("rental_rate")).alias("rental_rate"),
        F.when(F.col("film_id") % 5 != 0, F.col("replacement_cost")).alias("replacement_cost"),
        F.when(F.col("film_id") % 7 != 0, F.col("rating")).alias("rating"),
        F.when(F.col("film_id") % 2 != 0, at).alias("last_update"),
    )
    return with_table_defaults(films, "film", F.lit("2007-01-01 00:00:00").cast("timestamp_ntz"))


def _typed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a dump with every kind of field, read back; what does not compare is shown as text."""
    path = scratch_path(spark, "dump")
    orders = read_table(spark, folder, "orders")
    priority = F.col("o_orderpriority")
    typed = orders.select(
        F.col("o_orderkey").cast("long").alias("id"),
        (F.col("o_orderstatus") == "F").alias("done"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("at"),
        (F.col("o_orderkey") % 1000 / 100).cast("decimal(5,2)").alias("fee"),
        F.rpad(F.col("o_orderstatus"), 4, " ").alias("status"),
        F.to_binary(priority, F.lit("utf-8")).alias("raw"),
        F.array(priority, F.lit(None).cast("string"), F.concat(F.lit('a "b", \\c'), F.col("o_orderstatus"))).alias("notes"),
        F.array(F.col("o_orderstatus"), F.concat(priority, F.lit("'s"))).alias("words"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(priority, F.lit("\tx\\y\nz"))).alias("remark"),
    )
    copy_lines(typed, TYPED).write.text(path)
    back = read_copy_text(spark, path, TYPED)
    return back.select(
        "id", "done", "day", "at", F.col("fee").cast("double").alias("fee"), "status",
        F.hex("raw").alias("raw"), F.array_join("notes", "|", "NULL").alias("notes"), F.array_join("words", "|").alias("words"), "remark",
    )


def _loaded_shop(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables dumped, loaded as a shop, and checked against the declared rules of one."""
    path, shop = scratch_path(spark, "load"), shop_from_orders(spark, folder)
    at = F.lit("2006-02-15 00:00:00").cast("timestamp_ntz").alias("last_update")
    country = shop.country.select(F.col("country_id").cast("int"), F.col("country"), at)
    city = shop.city.select(F.col("city_id").cast("int"), F.when(F.col("city_id") % 5 != 0, F.col("city")).alias("city"), F.col("country_id").cast("short"), at)
    copy_lines(country.where("country_id <> 1")).write.text(f"{path}/country.dat")
    copy_lines(city).write.text(f"{path}/city.dat")
    loaded = load_shop(spark, {"country": f"{path}/country.dat", "city": f"{path}/city.dat"}, f"{path}/shop")
    return quality.check_shop(loaded, ["country", "city"])


def _search(spark: SparkSession, folder: str) -> DataFrame:
    return match_all_terms(token_index(read_table(spark, folder, "documents")), SEARCH)


def _active_customers(shop) -> DataFrame:
    return shop.customer.where("activebool")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem")




QUERIES: dict[str, Query] = {
    # analyses
    "top_titles_by_category": _orders(lambda s: top_titles_by_category(s, START, END)),
    "top_titles_by_category_film": _orders(lambda s: top_titles_by_category(s, START, END, by="film_id")),
    "mid_value_store_month": _orders(lambda s: mid_value_store_month(s, YEAR)),
    "mid_value_store_month_customer": _orders(lambda s: mid_value_store_month(s, YEAR, grain="customer")),
    "item_recommendations": _orders(item_recommendations),
    "customer_lifecycle": _orders(customer_lifecycle),
    "customer_lifecycle_other_rules": _orders(lambda s: customer_lifecycle(s, OTHER_RULES)),
    "customer_lifecycle_events": lambda spark, folder: plain(
        customer_lifecycle(shop_from_events(spark, folder), EVENT_RULES)
    ),
    "customer_lifecycle_incremental": _orders(_increment),
    "lifecycle_upsert": _orders(
        lambda s: incremental.lifecycle_upsert(_old_lifecycle(s), _increment(s))
    ),
    "lifecycle_upsert_all_tiers": _orders(
        lambda s: incremental.lifecycle_upsert(_old_lifecycle(s), _increment(s), tier_scope="all")
    ),
    "lifecycle_publish": _orders(_published),
    # parts of the recommendations
    "rental_history": _orders(lambda s: Recommendations(s).rental_history()),
    "favourite_category": _orders(lambda s: Recommendations(s).favourites),
    "movie_list": _orders(lambda s: Recommendations(s).movie_list()),
    "best_unseen_titles": _orders(lambda s: Recommendations(s).unseen().drop("place")),
    "unseen_titles_of": _orders(
        lambda s: Recommendations(s).unseen_of(s.customer.where(~F.col("activebool")))
        .select("customer_id", "category", "title", "film_id")
    ),
    "unseen_titles": _orders(lambda s: Recommendations(s).factored().settled().expand()),
    "unseen_title_counts": _orders(lambda s: Recommendations(s).unseen_counts()),
    "movie_recommend": _orders(lambda s: Recommendations(s).ranked()),
    # parts of the lifecycle
    "lc_total_revenue": _orders(lambda s: Lifecycle(s).total_revenue()),
    "lc_fav_three_actors": _orders(lambda s: Lifecycle(s).fav_three_actors()),
    "lc_first_latest_film": _orders(lambda s: Lifecycle(s).first_latest_film),
    "lc_first_latest_film_by_id": _orders(
        lambda s: Lifecycle(s, Rules(extremes="by_id")).first_latest_film
    ),
    "lc_thirty_days_date": _orders(lambda s: Lifecycle(s).first_period()),
    "lc_thirty_days_revenue": _orders(lambda s: Lifecycle(s).period_revenue),
    "lc_avg_rental_time": _orders(lambda s: Lifecycle(s).avg_rental_time()),
    "lc_revenue_growth_rate": _orders(lambda s: Lifecycle(s).revenue_growth_rate()),
    # parts of the increment
    "hwm_save": _orders(lambda s: incremental.high_water_mark(s.rental_core)),
    "hwm_read": _orders(_saved_mark),
    "staging_new_rows": _orders(lambda s: incremental.new_rentals(s.rental_core, _mark())),
    "staging_new_rows_tie_safe": _orders(
        lambda s: incremental.new_rentals(s.rental_core, incremental.Mark(MARK, 7500), tie_safe=True)
    ),
    "staging_with_history": _orders(_staging),
    "staging_uniqueness": _orders(_staging_twice),
    # streams
    "lifecycle_stream": _stream((0, 1, 2)),
    "lifecycle_stream_late": _stream((0, 2, 1)),
    "lifecycle_stream_drop_late": _stream((0, 2, 1), drop_late=True),
    "lifecycle_stream_stateful": _stream((1, 0, 2), stateful=True),
    "lifecycle_stream_payments": _two_streams(("r0", "p1", "r1", "p0")),
    "lifecycle_stream_payments_first": _two_streams(("p1", "r0", "p0", "r1")),
    # views
    "actor_info": _orders(views.actor_info),
    "actor_titles": _orders(views.actor_titles),
    "film_actors": _orders(views.film_actors),
    "customer_list": _orders(views.customer_list),
    "film_list": _orders(views.film_list),
    "nicer_film_list": _orders(views.nicer_film_list),
    "sales_by_category": _orders(views.sales_by_category),
    "sales_by_store": _orders(views.sales_by_store),
    "sales_by_category_kept": _orders(lambda s: _kept_sales(s).by_category()),
    "sales_by_store_kept": _orders(lambda s: _kept_sales(s).by_store()),
    "staff_list": _orders(views.staff_list),
    # functions
    "inventory_in_stock": _orders(stock.inventory_in_stock),
    "film_in_stock": _orders(stock.film_in_stock),
    "film_not_in_stock": _orders(stock.film_not_in_stock),
    "stock_counts": _orders(stock.stock_counts),
    "inventory_held_by": _orders(stock.inventory_held_by),
    "customer_balance": _orders(lambda s: accounts.customer_balance(s, BALANCE_DATE)),
    "customer_balance_replacement": _orders(
        lambda s: accounts.customer_balance(s, BALANCE_DATE, replacement=True)
    ),
    "customer_balances": _orders(_balances),
    "rewards_report": _orders(
        lambda s: accounts.rewards_report(s, REWARDS_PURCHASES, REWARDS_AMOUNT, REWARDS_DATE)
    ),
    "last_day": _orders(_month_ends),
    "group_concat": _event_types,
    "stamp_last_update": _orders(_stamped),
    "stamp_last_update_kept": _orders(lambda s: _snapshots(s)[0].read()),
    "snapshot_changes": _orders(lambda s: _snapshots(s)[1].changes),
    # sources and sinks
    "read_copy_text": _dump_round_trip,
    "read_copy_text_typed": _typed_round_trip,
    "load_and_check_shop": _loaded_shop,
    "write_table": _orders(_written),
    "append_table": _appended,
    "delete_using": _deleted,
    # rules
    "check_primary_key": lambda spark, folder: quality.check_primary_key(
        _lines(spark, folder), ["l_orderkey", "l_linenumber"]
    ),
    "check_unique": _orders(lambda s: quality.check_unique(s.rental_core, ["customer_id", "rental_date"])),
    "check_foreign_key": _orders(
        lambda s: quality.check_foreign_key(s.rental_core, "customer_id", _active_customers(s), "customer_id")
    ),
    "check_not_null": _orders(
        lambda s: quality.check_not_null(s.rental, ["rental_id", "rental_date", "inventory_id", "customer_id", "staff_id"])
    ),
    "check_range": _orders(lambda s: quality.check_range(s.film, "rental_duration", 3, 40)),
    "check_allowed": _orders(lambda s: quality.check_allowed(s.film, "rating", ["Brand#1", "Brand#2", "Brand#3"])),
    "check_length": _orders(lambda s: quality.check_length(s.film, {"title": 16, "description": 7})),
    "check_precision": _orders(lambda s: quality.check_precision(s.payment_core, "amount", 7, 2)),
    "assign_ids": _event_ids,
    "fill_defaults": _orders(_defaulted),
    "table_defaults": _orders(lambda s: plain(_table_defaults(s))),
    "distributed_ntile": _order_tiles,
    "distributed_row_number": _event_ranks,
    # text search
    "film_index": _orders(film_index),
    "token_index": lambda spark, folder: token_index(read_table(spark, folder, "documents")),
    "match_all_terms": _search,
    "token_index_kept": lambda spark, folder: _kept_index(spark, folder).postings(),
    "match_all_terms_kept": lambda spark, folder: _kept_index(spark, folder).match_all_terms(SEARCH),
}
