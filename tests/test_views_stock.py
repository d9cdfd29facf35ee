from __future__ import annotations

from decimal import Decimal

import pytest

from marquee.plans import accounts, stock, views
from tests.shops import by, film, payment, rental, rows, shop

WORLD = {
    "film": [film(1, "Bee"), film(2, "Ape"), film(3, "Cod"), film(4, "Eel")],
    "category": [(1, "Animals"), (2, "Fish"), (3, "Empty")],
    "film_category": [(1, 1), (2, 1), (3, 2)],  # film 4 has no category
    "actor": [(1, "DORIS", "kent"), (2, "Ed", "Chase"), (3, "No", "Films")],
    "film_actor": [(1, 1), (1, 2), (1, 3), (2, 1), (2, 4)],
    "inventory": [(10, 1, 1), (20, 2, 1), (30, 3, 2), (40, 4, 2), (50, 1, 2)],
    "customer": [(1, 1, "Mary", "Smith", 1, True), (2, 2, "Pat", "Jones", 2, False), (3, 1, "Lin", "Brown", 1, True)],
    "staff": [(1, "Mike", "Hill", 3, 1), (2, "Jon", "Step", 4, 2)],
    "store": [(1, 1, 3), (2, 2, 4)],
    "address": [(1, "1 A St", "100", "555", 1), (2, "2 B St", None, "556", 2), (3, "3 C St", "3", "5", 2), (4, "4 D St", "4", "6", 1)],
    "city": [(1, "London", 1), (2, "London", 2)],
    "country": [(1, "Canada"), (2, "United Kingdom")],
}


def test_actor_info(spark, joins):
    out = by(views.actor_info(shop(spark, **WORLD)), "actor_id")
    assert out[1]["film_info"] == "Animals: Ape, Bee, Fish: Cod"
    assert out[2]["film_info"] == "Animals: Bee"  # a film without category is not listed
    assert out[3]["film_info"] is None


def test_people_lists(spark, joins):
    s = shop(spark, **WORLD)
    customers = by(views.customer_list(s), "id")
    assert customers[1] == {
        "id": 1, "name": "Mary Smith", "address": "1 A St", "zip code": "100", "phone": "555",
        "city": "London", "country": "Canada", "notes": "active", "sid": 1,
    }
    assert customers[2]["notes"] == "" and customers[2]["zip code"] is None
    assert {r["name"]: r["country"] for r in rows(views.staff_list(s))} == {
        "Mike Hill": "United Kingdom", "Jon Step": "Canada",
    }


def test_film_lists(spark, joins):
    s = shop(spark, **WORLD)
    plain = by(views.film_list(s), "fid")
    assert set(plain) == {1, 2, 3}  # film 4 has no category
    assert plain[1]["actors"] == "DORIS kent, Ed Chase" and plain[1]["price"] == Decimal("0.99")
    assert by(views.nicer_film_list(s), "fid")[1]["actors"] == "DorisKent, EdChase"


def test_sales(spark, joins):
    rentals = [rental(1, 1, "2005-01-01", 10), rental(2, 1, "2005-01-01", 30), rental(3, 2, "2005-01-01", 40)]
    payments = [payment(1, 1, "1.00"), payment(2, 1, "2.50"), payment(3, 2, "9.00"), payment(4, 3, "5.00"), payment(5, 99, "7")]
    s = shop(spark, rental=rentals, payment=payments, **WORLD)
    assert rows(views.sales_by_category(s)) == [
        {"category": "Fish", "total_sales": Decimal("9.00")},
        {"category": "Animals", "total_sales": Decimal("3.50")},
    ]
    assert [tuple(r.values()) for r in rows(views.sales_by_store(s))] == [
        ("London,Canada", "Jon Step", Decimal("14.00")),
        ("London,United Kingdom", "Mike Hill", Decimal("3.50")),
    ]


def test_stock(spark):
    rentals = [
        rental(1, 1, "2005-01-01", 10, "2005-01-05"), rental(2, 2, "2005-02-01", 10),
        rental(3, 1, "2005-02-01", 20, "2005-02-02"), rental(4, 3, "2005-03-01", 30), rental(5, 2, "2005-03-02", 30),
    ]
    s = shop(spark, rental=rentals, **WORLD)
    assert {r["inventory_id"]: r["in_stock"] for r in rows(stock.inventory_in_stock(s))} == {
        10: False, 20: True, 30: False, 40: True, 50: True,
    }
    assert [r["inventory_id"] for r in rows(stock.film_in_stock(s).where("film_id = 1 and store_id = 2"))] == [50]
    assert [r["inventory_id"] for r in rows(stock.film_not_in_stock(s).where("film_id = 1"))] == [10]
    assert {(r["film_id"], r["store_id"]): (r["num_in_stock"], r["num_out"]) for r in rows(stock.stock_counts(s))}[
        (1, 1)
    ] == (0, 1)
    held = {r["inventory_id"]: r["customer_id"] for r in rows(stock.inventory_held_by(s))}
    assert held == {10: 2, 30: 2}


def test_customer_balance(spark, joins):
    world = {**WORLD, "film": [film(1, "Bee", "2.99", 3, "20.00"), film(2, "Ape", "0.99", 5, "10.00")]}
    rentals = [
        rental(1, 1, "2005-01-01", 10, "2005-01-06T12:00"),  # 2.5 days late: 2
        rental(2, 1, "2005-01-01", 20, "2005-01-06"),  # in time
        rental(3, 1, "2005-01-01", 10, "2005-01-12"),  # 8 days late, more than twice 3
        rental(4, 1, "2005-03-01", 10, None),  # after the date
        rental(5, 2, "2005-01-01", 10, None),
        rental(6, 1, "2005-01-01", None, None),  # no copy: no fee
    ]
    payments = [payment(1, 1, "5.00", 1, "2005-01-02"), payment(2, 1, "9.00", 1, "2005-02-02")]
    s = shop(spark, rental=rentals, payment=payments, **world)
    out = {r["customer_id"]: r["balance"] for r in rows(accounts.customer_balance(s, "2005-02-01"))}
    assert out == {1: Decimal("2.99") * 2 + Decimal("0.99") + 2 + 8 - 5, 2: Decimal("2.99"), 3: 0}
    kept = {r["customer_id"]: r["balance"] for r in rows(accounts.customer_balance(s, "2005-02-01", True))}
    assert kept[1] == out[1] + 20


def test_rewards_report(spark):
    payments = [
        payment(1, 1, "5.00", 1, "2005-05-01"), payment(2, 1, "5.01", 1, "2005-05-31T23:59:59"),
        payment(3, 1, "50", 1, "2005-06-01"),
        payment(4, 1, "10.00", 2, "2005-05-10"), payment(5, 1, "0", 2, "2005-05-10"),  # not above 10
        payment(6, 1, "99", 3, "2005-05-10"),  # one purchase only
    ]
    s = shop(spark, payment=payments, **WORLD)
    out = rows(accounts.rewards_report(s, 1, 10.0, "2005-08-31"))
    assert [r["customer_id"] for r in out] == [1] and out[0]["last_name"] == "Smith"
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            accounts.rewards_report(s, *bad, "2005-08-31")
