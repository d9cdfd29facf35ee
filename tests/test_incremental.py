from __future__ import annotations

import random
from decimal import Decimal

import pytest

from marquee.operators.changes import delete_using, fill_defaults, stamp_changes, upsert
from marquee.plans import incremental as inc
from marquee.plans.lifecycle import COLUMNS, Rules, customer_lifecycle
from marquee.sources.versions import VersionedTable
from marquee.streaming.state import collect_state, lifecycle_of, merge_state
from tests.shops import COLUMNS as SHOP_COLUMNS
from tests.shops import at, by, film, frame, payment, rental, rows, shop
from tests.test_lifecycle import FILMS

OLD = [
    rental(1, 3, "2006-02-14T15:16:03", 10),
    rental(2, 3, "2006-02-14T15:17:03", 20),
    rental(3, 4, "2006-02-14T15:30:03", 10),
    rental(4, 5, "2006-02-14T16:14:03", 20),
]
NEW = [rental(5, 3, "2006-02-14T16:18:34", 30), rental(6, 6, "2006-02-14T16:30:44", 10)]


def test_worked_example(spark, joins):
    before, after = shop(spark, rental=OLD, **FILMS), shop(spark, rental=OLD + NEW, **FILMS)
    mark = rows(inc.high_water_mark(before.rental))[0]
    assert mark == {"latest_date": at("2006-02-14T16:14:03"), "latest_id": 4}
    new = inc.new_rentals(after.rental, inc.Mark(**mark))
    assert sorted(r["rental_id"] for r in rows(new)) == [5, 6]
    staging = inc.with_history(after.rental, new)
    assert sorted((r["customer_id"], r["rental_id"]) for r in rows(staging)) == [(3, 1), (3, 2), (3, 5), (6, 6)]
    assert rows(inc.staging_duplicates(staging)) == []
    rules = Rules(single_rental="same")
    merged = by(
        inc.lifecycle_upsert(customer_lifecycle(before, rules), inc.lifecycle_increment(after, new, rules)),
        "customer_id",
    )
    assert {c: r["last_rental_date"] for c, r in merged.items()} == {
        3: at("2006-02-14T16:18:34"),
        4: at("2006-02-14T15:30:03"),
        5: at("2006-02-14T16:14:03"),
        6: at("2006-02-14T16:30:44"),
    }


def test_mark_and_equal_times(spark, tmp_path):
    control = VersionedTable(spark, str(tmp_path / "mark"))
    assert inc.read_mark(control) is None
    s = shop(spark, rental=OLD)
    assert inc.new_rentals(s.rental, None).count() == 4
    inc.save_mark(s.rental, control)
    inc.save_mark(s.rental, control)
    mark = inc.read_mark(control)
    late = shop(spark, rental=[*OLD, rental(9, 7, "2006-02-14T16:14:03", 10)]).rental
    assert inc.new_rentals(late, mark).count() == 0
    assert [r["rental_id"] for r in rows(inc.new_rentals(late, mark, tie_safe=True))] == [9]


def random_shop(seed: int):
    rng = random.Random(seed)
    rentals = [
        rental(n, rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), f"2005-{rng.randint(1, 6):02d}-{rng.randint(1, 28):02d}",
               rng.choice([10, 11, 20, 30, None]))
        for n in range(1, 121)
    ]
    payments = [payment(n, rng.randint(1, 120), f"{rng.randint(0, 900) / 100:.2f}") for n in range(1, 150)]
    return rentals, payments


def lines(df):
    return sorted(str([r[c] for c in COLUMNS]) for r in rows(df))


@pytest.mark.parametrize("rules", [Rules(), Rules(single_rental="same", denominator="gaps", actors_by="actor_id")])
def test_increments_and_state_equal_full_recompute(spark, tmp_path, rules):
    rentals, payments = random_shop(5)
    batches = [rentals[0:50], rentals[50:70], rentals[70:72], rentals[72:120]]  # dates are not in batch order
    batch_frame = lambda data: frame(spark, data, SHOP_COLUMNS["rental"])
    table = VersionedTable(spark, str(tmp_path / "lifecycle"))
    state, so_far = None, []
    for number, batch in enumerate(batches):
        so_far += batch
        s = shop(spark, rental=so_far, payment=payments, **FILMS)
        increment = inc.lifecycle_increment(s, batch_frame(batch), rules)
        table.write(increment if number == 0 else inc.lifecycle_upsert(table.read(), increment, "all"))
        fresh = collect_state(s, batch_frame(batch), rules) if state is None else merge_state(state, s, batch_frame(batch), rules)
        state = fresh.settled()
    full = lines(customer_lifecycle(shop(spark, rental=rentals, payment=payments, **FILMS), rules))
    assert lines(table.read()) == full
    assert lines(lifecycle_of(state, rules)) == full


def test_batch_tiers_rank_the_increment_only(spark):
    rentals = [rental(c, c, "2005-01-01", 10) for c in range(1, 11)]
    s = shop(spark, rental=rentals, payment=[payment(c, c, f"{c}.00") for c in range(1, 11)], **FILMS)
    new = s.rental.where("rental_id in (1, 2)")
    increment = by(inc.lifecycle_increment(s, new), "customer_id")
    assert {c: r["value_tier"] for c, r in increment.items()} == {2: 1, 1: 2}
    old = customer_lifecycle(s)
    kept = by(inc.lifecycle_upsert(old, inc.lifecycle_increment(s, new)), "customer_id")
    assert [kept[c]["value_tier"] for c in (1, 2, 3, 10)] == [2, 1, 8, 1]
    ranked = by(inc.lifecycle_upsert(old, inc.lifecycle_increment(s, new), "all"), "customer_id")
    assert [ranked[c]["value_tier"] for c in (1, 2, 3, 10)] == [10, 9, 8, 1]


def test_upsert_is_idempotent_and_keeps_newer_rows(spark):
    schema = "k int, v string, d int"
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", None)], schema)
    new = spark.createDataFrame([(2, "B", 6), (1, "A", 4), (3, "C", 1), (4, "D", None)], schema)
    once = upsert(old, new, ["k"], "d")
    expected = {(1, "a", 5), (2, "B", 6), (3, "C", 1), (4, "D", None)}
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in upsert(once, new, ["k"], "d").collect()} == expected
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "A", 4), (2, "B", 6), (3, "C", 1), (4, "D", None)}


def test_stamp_fill_and_delete(spark):
    schema = "k int, v string, last_update int"
    old = spark.createDataFrame([(1, "a", 10), (2, None, 10), (3, "c", 10)], schema)
    new = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "x", 0), (4, "n", 0)], schema)
    from pyspark.sql import functions as F

    out = stamp_changes(old, new, ["k"], F.lit(99))
    assert {(r.k, r.last_update) for r in out.collect()} == {(1, 10), (2, 10), (3, 99), (4, 99)}
    filled = fill_defaults(old, {"v": F.lit(7)})
    assert {(r.k, r.v) for r in filled.collect()} == {(1, "a"), (2, "7"), (3, "c")}
    assert {r.k for r in delete_using(new, old.where("k < 3"), ["k"]).collect()} == {3, 4}
