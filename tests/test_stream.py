from __future__ import annotations

import pytest

from marquee.operators.settle import settle
from marquee.plans.lifecycle import SCHEMA, Rules, customer_lifecycle
from marquee.sources.versions import fit_schema
from marquee.streaming.lifecycle_stream import LifecycleStream, rental_files
from tests.shops import COLUMNS, payment, rental, shop
from tests.test_incremental import lines, random_shop
from tests.test_lifecycle import FILMS


def arrive(spark, inbox: str, batch, kind: str = "rental") -> None:
    spark.createDataFrame(batch, COLUMNS[kind]).coalesce(1).write.mode("append").parquet(inbox)


def kept(table) -> list[str]:
    """A lifecycle as the stream stores it."""
    return lines(fit_schema(table, SCHEMA))


@pytest.mark.parametrize("stateful", [False, True])
def test_stream_equals_batch_and_survives_replay(spark, tmp_path, stateful):
    rentals, payments = random_shop(11)
    base = shop(spark, payment=payments, **FILMS)
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "out")
    schema = base.rental.schema
    for part in (rentals[60:120], rentals[0:60]):
        arrive(spark, inbox, part)
        stream = LifecycleStream(base, path, stateful=stateful, buckets=2)  # a restart each time
        table = stream.run(rental_files(spark, inbox, schema))
    full = kept(customer_lifecycle(base.replace(rental=spark.createDataFrame(rentals, schema))))
    assert lines(table) == full
    # the last batch once more, as after a failure between publishing and the stream's own commit
    stream.process(spark.createDataFrame(rentals[0:60], schema), 1)
    assert lines(stream.lifecycle.read()) == full and stream.lifecycle.latest() == 1
    # nothing new: nothing changes
    assert lines(stream.run(rental_files(spark, inbox, schema))) == full


def test_late_rentals_can_be_dropped(spark, tmp_path):
    rentals, payments = random_shop(12)
    rentals.sort(key=lambda r: r[1])
    base = shop(spark, payment=payments, **FILMS)
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "out")
    cut = next(i for i in range(80, 119) if rentals[i][1] != rentals[i + 1][1]) + 1
    for part in (rentals[40:cut], rentals[0:40] + rentals[cut:]):
        arrive(spark, inbox, part)
        stream = LifecycleStream(base, path, Rules(), drop_late=True, buckets=2)
        table = stream.run(rental_files(spark, inbox, base.rental.schema))
    not_late = base.replace(rental=spark.createDataFrame(rentals[40:], base.rental.schema))
    assert lines(table) == kept(customer_lifecycle(not_late))


def test_several_batches_in_one_run_with_batch_tiers(spark, tmp_path):
    rentals, payments = random_shop(13)
    base = shop(spark, payment=payments, **FILMS)
    inbox = str(tmp_path / "inbox")
    arrive(spark, inbox, rentals[0:60])
    arrive(spark, inbox, rentals[60:120])
    stream = LifecycleStream(base, str(tmp_path / "out"), tier_scope="batch", buckets=2)
    table = stream.run(rental_files(spark, inbox, base.rental.schema, files_per_batch=1))
    full = fit_schema(customer_lifecycle(base.replace(rental=spark.createDataFrame(rentals, base.rental.schema))), SCHEMA)
    assert lines(table.drop("value_tier").selectExpr("*", "0 as value_tier")) == lines(
        full.drop("value_tier").selectExpr("*", "0 as value_tier")
    )
    assert stream.lifecycle.latest() >= 1


@pytest.mark.parametrize("arrivals", ["rp pr", "pp rr"])
def test_payments_arrive_as_a_second_stream(spark, tmp_path, arrivals):
    """Whatever comes first, the lifecycle is that of all rentals and payments."""
    rentals, payments = random_shop(14)
    base = shop(spark, **FILMS)
    stream = LifecycleStream(base, str(tmp_path / "out"), payments=True, buckets=2)
    left = {"r": [rentals[0:70], rentals[70:120]], "p": [payments[75:], payments[:75]]}
    for kind in arrivals.replace(" ", ""):
        inbox, name = str(tmp_path / kind), {"r": "rental", "p": "payment"}[kind]
        arrive(spark, inbox, left[kind].pop(0), name)
        files = rental_files(spark, inbox, getattr(base, name).schema)
        stream = LifecycleStream(base, str(tmp_path / "out"), payments=True, buckets=2)  # a restart each time
        table = stream.run(rentals=files) if kind == "r" else stream.run(payments=files)
    whole = shop(spark, rental=rentals, payment=payments, **FILMS)
    assert lines(table) == kept(customer_lifecycle(whole))
    known = {r[0] for r in rentals}
    waiting = stream.store.read("waiting").count()
    assert waiting == sum(p[3] not in known for p in payments)


def test_a_batch_reads_and_rewrites_its_customers_buckets(spark, tmp_path):
    rentals = [rental(n, n % 200, f"2005-0{n % 6 + 1}-1{n % 9}", 10) for n in range(1, 1001)]
    base = shop(spark, payment=[payment(n, n, f"{n % 37}.50") for n in range(1, 1001)], **FILMS)
    stream = LifecycleStream(base, str(tmp_path / "out"), buckets=40)
    frame = lambda data: spark.createDataFrame(data, COLUMNS["rental"])
    stream.process(frame(rentals), 0)
    before = {t: set(stream.store.files(t)) for t in ("lifecycle", "rentals")}
    old = stream.lifecycle.read(0)
    old_rows = lines(old)
    more = [rental(2000, 7, "2005-06-20", 20), rental(2001, 8, "2004-06-20", 20)]
    stream.process(frame(more), 1)
    for table, files in before.items():
        after = set(stream.store.files(table))
        assert 1 <= len(after - files) <= 2 and len(files) > 30
        assert len(files - after) == (len(after - files) if table == "lifecycle" else 0)
    read = stream.store.read("rentals", frame(more)).inputFiles()
    assert len(read) <= 4  # two buckets, each with what it had and what came
    assert lines(old) == old_rows  # who has found the old version keeps it
    assert 0 < stream.sorted_rows < 20  # of 200 customers, for the tiers
    whole = base.replace(rental=frame(rentals + more))
    assert lines(stream.lifecycle.read()) == kept(customer_lifecycle(whole))
    assert lines(stream.lifecycle.read(touching=frame(more))) == [r for r in kept(customer_lifecycle(whole)) if r.startswith(("[7,", "[8,"))]


@pytest.mark.parametrize("stateful", [False, True])
def test_rentals_of_a_batch_are_written_once_and_history_only_where_it_is_read(spark, tmp_path, monkeypatch, stateful):
    """What a batch brings lies in the store and nowhere else; the state reads back customers whose first date moved."""
    written = {}

    def noted(df, label, *args, **options):
        found = settle(df, label, *args, **options)
        written.setdefault(label, []).append(found.count())
        return found

    monkeypatch.setattr("marquee.streaming.lifecycle_stream.settle", noted)
    monkeypatch.setattr("marquee.streaming.state.settle", noted)
    rentals = [rental(n, n % 20, f"2005-0{n % 6 + 1}-1{n % 9}", 10) for n in range(1, 101)]
    base = shop(spark, payment=[payment(n, n, f"{n % 37}.50") for n in range(1, 101)], **FILMS)
    stream = LifecycleStream(base, str(tmp_path / "out"), stateful=stateful, buckets=2)
    frame = lambda data: spark.createDataFrame(data, COLUMNS["rental"])
    stream.process(frame(rentals), 0)
    more = [rental(2000, 7, "2005-06-20", 20), rental(2001, 8, "2004-06-20", 20)]
    stream.process(frame(more), 1)
    assert "batch" not in written
    assert written.get("history") == (None if stateful else [100, 12]) and written.get("state-history") == ([0, 6] if stateful else None)
    whole = base.replace(rental=frame(rentals + more))
    assert lines(stream.lifecycle.read()) == kept(customer_lifecycle(whole))
