from __future__ import annotations

from decimal import Decimal

import pytest

from marquee.plans import facts, lifecycle
from marquee.plans.lifecycle import Lifecycle, Rules, customer_lifecycle
from tests.shops import at, by, days, film, frame, payment, rental, shop

FILMS = {
    "film": [film(1, "Ape"), film(2, "Bee"), film(3, "Cod")],
    "inventory": [(10, 1, 1), (11, 1, 1), (20, 2, 1), (30, 3, 1)],
    "actor": [(1, "Rosa", "Lund"), (2, "Rosa", "Lund"), (3, "Ed", "Chase"), (4, "Al", "Berry"), (5, "Zoe", "West")],
    "film_actor": [(1, 1), (3, 1), (2, 2), (4, 2), (5, 2)],  # film 3 has no cast
}


def life(spark, rentals, payments=(), rules=Rules()):
    return by(customer_lifecycle(shop(spark, rental=rentals, payment=list(payments), **FILMS), rules), "customer_id")


def test_growth_of_the_worked_customer(spark, joins):
    # 21.93 in the first 30 days (0.731 a day), 138.65 in all; 234.3 days later: 0.498 a day
    first = at("2005-05-26T00:00")
    last = first + days(30) + days(234.3)
    rentals = [rental(1, 29, first, 10), rental(2, 29, first + days(29), 20), rental(3, 29, last, 30)]
    row = life(spark, rentals, [payment(1, 1, "10.93"), payment(2, 2, "11.00"), payment(3, 3, "116.72")])[29]
    assert row["thirty_days_revenue"] == Decimal("21.93") and row["total_revenue"] == Decimal("138.65")
    per_day, after = Decimal("21.93") / 30, Decimal("116.72") / Decimal("234.3")
    assert round(per_day, 3) == Decimal("0.731") and round(after, 3) == Decimal("0.498")
    assert row["revenue_growth_rate"] == round((after - per_day) / per_day * 100, 2) == Decimal("-31.85")


def test_growth_without_early_revenue_and_at_the_edges(spark):
    start = at("2005-01-01T00:00")
    rentals = [
        rental(1, 1, start, 10), rental(2, 1, start + days(40), 20),  # pays only later
        rental(3, 2, start, 10), rental(4, 2, start + days(30), 20),  # last exactly on day 30
        rental(5, 3, start, 10), rental(6, 3, start + days(12), 20),  # whole life inside
        rental(7, 4, start, 10),  # one rental
    ]
    payments = [payment(2, 2, "5.00"), payment(3, 3, "2.00"), payment(4, 4, "3.00"), payment(5, 5, "4.00")]
    out = life(spark, rentals, payments)
    assert out[1]["revenue_growth_rate"] == Decimal("50.00")  # 5.00 over 10 days, absolute, times 100
    assert out[2]["thirty_days_revenue"] == Decimal("2.00")  # the period is half open
    assert out[2]["revenue_growth_rate"] is None
    assert out[3]["revenue_growth_rate"] == Decimal("-100.00")
    assert out[4]["revenue_growth_rate"] is None and out[4]["thirty_days_revenue"] == 0


def test_one_time_renters(spark, joins):
    rentals = [rental(1, 1, "2005-01-01", 10)]
    row = life(spark, rentals)[1]
    assert (row["first_film"], row["latest_film"], row["last_rental_date"]) == (None, None, None)
    assert row["avg_time_days_between_rental"] is None and row["first_rent_date"] == at("2005-01-01")
    same = life(spark, rentals, rules=Rules(single_rental="same"))[1]
    assert (same["first_film"], same["latest_film"]) == ("Ape", "Ape")
    assert same["avg_time_days_between_rental"] == 0
    gaps = life(spark, rentals, rules=Rules(single_rental="same", denominator="gaps"))[1]
    assert gaps["avg_time_days_between_rental"] is None


def test_payments_multiply_rows_but_not_revenue(spark):
    rentals = [rental(1, 1, "2005-01-01", 10), rental(2, 1, "2005-01-13", 20)]
    payments = [payment(1, 1, "1.00"), payment(2, 1, "2.00"), payment(3, 1, "3.00")]
    rows, rentals_, gaps = (
        life(spark, rentals, payments, Rules(denominator=d))[1] for d in ("rows", "rentals", "gaps")
    )
    assert rows["total_revenue"] == Decimal("6.00")
    assert rows["avg_time_days_between_rental"] == 3  # 12 days over 3 + 1 rows
    assert rentals_["avg_time_days_between_rental"] == 6
    assert gaps["avg_time_days_between_rental"] == 12


def test_first_and_last_by_date_or_by_id(spark, joins):
    # ids are not chronological; two rentals share the first date
    rentals = [
        rental(5, 1, "2005-01-01", 10), rental(4, 1, "2005-01-01", 20),
        rental(1, 1, "2005-02-01", 30), rental(2, 1, "2005-01-15", 10),
    ]
    s = shop(spark, rental=rentals, **FILMS)
    chronological = by(Lifecycle(s).first_latest_film, "customer_id")[1]
    assert (chronological["first_film"], chronological["latest_film"]) == ("Bee", "Cod")
    # by id, among the rentals at either end (4, 5 and 1): lowest is 1, highest is 5
    by_id = by(Lifecycle(s, Rules(extremes="by_id")).first_latest_film, "customer_id")[1]
    assert (by_id["first_film"], by_id["latest_film"]) == ("Ape", "Cod")
    assert by_id["first_rental_date"] == at("2005-01-01") and by_id["last_rental_date"] == at("2005-02-01")


def test_customers_whose_last_film_is_unknown(spark):
    rentals = [rental(1, 1, "2005-01-01", 10), rental(2, 1, "2005-02-01", None)]
    assert life(spark, rentals)[1]["first_film"] is None


def test_favourite_actors(spark, joins):
    rentals = [
        rental(1, 1, "2005-01-01", 10), rental(2, 1, "2005-01-02", 20), rental(3, 1, "2005-01-03", 30),
        rental(4, 2, "2005-01-01", 30), rental(5, 2, "2005-01-02", None),
    ]
    out = life(spark, rentals)
    favourites = lambda row: [row[f"fav_actor_{n}"] for n in ("one", "two", "three")]
    # namesakes count together: Rosa Lund is seen in both films
    assert favourites(out[1]) == ["Rosa Lund", "Al Berry", "Ed Chase"]
    # films without cast and rentals without copy are a nameless actor in first place
    assert favourites(out[2]) == [None, None, None]
    apart = life(spark, rentals, rules=Rules(actors_by="actor_id"))
    assert favourites(apart[1]) == ["Al Berry", "Ed Chase", "Rosa Lund"]


@pytest.mark.parametrize("customers", [3, 25])
def test_value_tiers(spark, customers):
    rentals = [rental(c, c, "2005-01-01", 10) for c in range(1, customers + 1)]
    payments = [payment(c, c, f"{c // 2}.00") for c in range(1, customers + 1)]
    out = life(spark, rentals, payments)
    order = sorted(out, key=lambda c: (-(c // 2), c))
    size, extra = divmod(customers, 10)
    expected = [t for t in range(1, 11) for _ in range(size + (t <= extra))]
    assert [out[c]["value_tier"] for c in order] == expected


@pytest.mark.parametrize("by", ["name", "actor_id"])
@pytest.mark.parametrize("heavy", [3, 4096])
def test_favourites_come_from_lists_of_numbers(spark, monkeypatch, by, heavy):
    monkeypatch.setattr(lifecycle, "HEAVY", heavy)
    monkeypatch.setattr(lifecycle, "PAIRS", 20)
    monkeypatch.setattr(facts, "CAST_BLOCK", 2)
    people = [(1, "A", "X"), (2, "B", "X"), (3, "A", "X"), (4, None, "X"), (5, "C", "Y"), (5, "C", "Y"), (6, "D", "Y")]
    cast = [(a, f) for f in range(1, 9) for a in range(1, 9) if (a * f) % 5 < 3] + [(None, 2), (1, None), (2, 3)]
    s = shop(spark, actor=people, film_actor=cast)
    watched = frame(
        spark, [(c, f, (f or 1) % 3) for c in (1, 2, 3, 4, None) for f in (*range(1, 2 + (c or 2) * 2), None, 99)], "customer_id int, film_id int, times long"
    )
    rules = Rules(actors_by=by)
    want = lifecycle.three_favourites(lifecycle.watched_actors(s, watched, rules))
    found = lifecycle.favourite_actors(s, watched, rules)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_customers_times_casts_are_not_shuffled(spark):
    s = shop(spark, rental=[rental(1, 1, "2005-01-01", 1)], inventory=[(1, 1, 1)], film=[film(1, "F")], film_actor=[(1, 1)], actor=[(1, "A", "X")])
    plan = Lifecycle(s).fav_three_actors()._jdf.queryExecution().executedPlan().toString()
    counted = plan[plan.index("Window") : plan.index("Generate explode")]
    assert "Exchange" not in counted


def test_a_film_recorded_twice_counts_twice(spark):
    s = shop(
        spark, rental=[rental(1, 1, "2005-01-01", 1), rental(2, 1, "2005-01-02", 2), rental(3, 1, "2005-01-03", 3)],
        inventory=[(1, 1, 1), (2, 2, 1), (3, 3, 1)], film=[film(1, "F"), film(2, "G"), film(2, "G"), film(3, "H"), film(3, "H"), film(3, "H")],
        film_actor=[(1, 1), (2, 2)], actor=[(1, "A", "X"), (2, "B", "X")],
    )
    row = Lifecycle(s).fav_three_actors().first()
    assert tuple(row) == (1, None, "B X", "A X")
