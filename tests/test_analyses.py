from __future__ import annotations

import random
from decimal import Decimal

import pytest

from marquee.plans.popularity import top_titles_by_category
from marquee.plans.recommend import Recommendations, _block, item_recommendations
from marquee.plans.store_value import mid_value_store_month
from tests.shops import film, payment, rental, rows, shop


@pytest.fixture
def catalogue():
    return {
        "film": [film(1, "Ape"), film(2, "Bee"), film(3, "Bee"), film(4, "Cod")],
        "category": [(1, "Animals"), (2, "Fish")],
        "film_category": [(1, 1), (2, 1), (3, 1)],  # film 4 has no category
        "inventory": [(10, 1, 1), (20, 2, 1), (21, 2, 2), (30, 3, 1), (40, 4, 2)],
    }


def test_titles_are_merged_ranked_and_bounded_by_dates(spark, joins, catalogue):
    rentals = [
        rental(1, 1, "2005-01-01T00:00", 20),  # first moment counts
        rental(2, 2, "2005-06-30T23:59:59", 30),  # last day counts, same title as film 2
        rental(3, 1, "2005-07-01T00:00", 10),  # after the period
        rental(4, 1, "2005-03-01", 10),
        rental(5, 1, "2005-03-02", 10),
        rental(6, 1, "2005-03-03", 40),
        rental(7, 1, "2005-03-04", None),
    ]
    s = shop(spark, rental=rentals, **catalogue)
    out = [tuple(r.values()) for r in rows(top_titles_by_category(s, "2005-01-01", "2005-06-30"))]
    # equal counts are ordered by title; the missing category is a group of its own
    assert sorted(out, key=str) == sorted(
        [("Animals", "Ape", 2), ("Animals", "Bee", 2), (None, "Cod", 1), (None, None, 1)], key=str
    )
    one = rows(top_titles_by_category(s, "2005-01-01", "2005-06-30", k=1))
    assert {(r["category_name"], r["title"]) for r in one} == {("Animals", "Ape"), (None, "Cod")}
    films = rows(top_titles_by_category(s, "2005-01-01", "2005-06-30", by="film_id"))
    assert {(r["film_id"], r["num_of_rental"]) for r in films} == {(1, 2), (2, 1), (3, 1), (4, 1), (None, 1)}


def test_value_per_store_and_month(spark, joins, catalogue):
    # customers 1..12 pay 1..12: two tiles of two, eight of one; the middle is 3..11
    rentals = [rental(c, c, f"2005-0{1 + c % 2}-10", 20 if c % 3 else 21) for c in range(1, 13)]
    rentals += [rental(90, 5, "2004-12-31T23:59", 20), rental(91, 5, "2006-01-01", 20)]
    payments = [payment(c, c, f"{c}.00") for c in range(1, 13)]
    payments.append(payment(99, 7, "3.00"))  # a second payment makes a second row: 7 pays 10
    payments += [payment(100, 90, "500"), payment(101, 91, "500")]
    s = shop(spark, rental=rentals, payment=payments, **catalogue)
    order = sorted([(10 if c == 7 else c, c) for c in range(1, 13)])
    tile, middle = 0, set()
    for position, (_, customer) in enumerate(order):
        tile = position // 2 + 1 if position < 4 else position - 1
        if 2 <= tile <= 9:
            middle.add(customer)
    cells: dict = {}
    for c in middle:
        amounts = [Decimal(7), Decimal(3)] if c == 7 else [Decimal(c)]
        cells.setdefault((f"2005-0{1 + c % 2}", 1 if c % 3 else 2), []).extend(amounts)
    expected = {cell: round(sum(v) / len(v), 6) for cell, v in cells.items()}
    out = rows(mid_value_store_month(s, 2005))
    assert {(r["month"], r["store_id"]): r["amount"] for r in out} == expected
    assert [(r["month"], r["store_id"]) for r in out] == sorted(expected)
    customers = rows(mid_value_store_month(s, 2005, grain="customer"))
    seven = next(r for r in customers if r["month"] == "2005-02" and r["store_id"] == 1)
    members = [c for c in middle if c % 2 and c % 3]
    assert seven["amount"] == round(Decimal(sum(10 if c == 7 else c for c in members)) / len(members), 6)


def test_rentals_without_payment_count_as_zero(spark, catalogue):
    rentals = [rental(c, c, "2005-01-10", 20) for c in range(1, 4)]
    s = shop(spark, rental=rentals, payment=[payment(1, 1, "6.00")], **catalogue)
    # three customers in ten tiles: 2 (nothing), 3 (nothing), 1 -> tiles 1, 2, 3
    out = rows(mid_value_store_month(s, 2005))
    assert out == [{"month": "2005-01", "store_id": 1, "amount": Decimal("3.000000")}]


def recommended(catalogue, rentals, k, names):
    """Brute force over customers and films."""
    films, filed, copies = catalogue
    categories: dict = {}
    for f, c in filed:
        categories.setdefault(f, []).append(c)
    result = set()
    for customer in {r[3] for r in rentals}:
        if customer not in names:
            continue
        counts, seen = {}, set()
        for r in rentals:
            if r[3] != customer:
                continue
            f = copies.get(r[2])
            for c in categories.get(f, [None]):
                counts[c] = counts.get(c, 0) + 1
                if c is not None:
                    seen.add(films[f][1])
        best = [c for c, n in counts.items() if n == max(counts.values()) and c is not None]
        options = sorted(
            (-films[f][4], films[f][3], f, c) for f, cs in categories.items() for c in cs if c in best and films[f][1] not in seen
        )
        result |= {(customer, c, f) for _, _, f, c in options[:k]}
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_recommendations_equal_brute_force(spark, joins, seed):
    rng = random.Random(seed)
    films = {
        i: film(i, f"T{i if rng.random() < 0.9 else i // 2}", f"{rng.randint(0, 3)}.99", rng.randint(3, 5))
        for i in range(1, 161)
    }
    filed = [(i, 1 if rng.random() < 0.7 else rng.randint(2, 3)) for i in films if rng.random() < 0.97]
    filed += [(i, 4) for i in (5, 6, 7)]  # films in a second category
    filed = list(dict.fromkeys(filed))
    copies = {i + 1000: i for i in films}
    rentals, number = [], 0
    for customer in range(1, 25):
        # customer 1 has seen almost everything, so many blocks are needed
        count = 400 if customer == 1 else rng.randint(1, 12)
        for _ in range(count):
            number += 1
            copy = None if rng.random() < 0.05 else rng.randint(1001, 1160)
            rentals.append(rental(number, customer, "2005-01-01", copy))
    names = set(range(1, 24))  # customer 24 has no record
    s = shop(
        spark,
        film=list(films.values()),
        category=[(c, f"C{c}") for c in range(1, 5)],
        film_category=filed,
        inventory=[(c, f, 1) for c, f in copies.items()],
        customer=[(c, 1, "Ann", "Lee", c, True) for c in names],  # all namesakes
        rental=rentals,
    )
    out = {(r["customer_id"], int(r["category"][1:]), r["film_id"]) for r in rows(item_recommendations(s, k=5))}
    assert out == recommended((films, filed, copies), rentals, 5, names)


def test_favourite_category_without_name_gives_nothing(spark, catalogue):
    rentals = [rental(1, 1, "2005-01-01", 40), rental(2, 1, "2005-01-02", 40), rental(3, 1, "2005-01-02", 10)]
    s = shop(spark, rental=rentals, customer=[(1, 1, "A", "B", 1, True)], **catalogue)
    parts = Recommendations(s)
    assert [(r["category"], r["num_rental"]) for r in rows(parts.favourites)] == [(None, 2)]
    assert rows(parts.table()) == []
    history = {(r["title"], r["category"], r["num_rental"]) for r in rows(parts.rental_history())}
    assert history == {("Cod", None, 2), ("Ape", "Animals", 1)}


def test_unseen_counts(spark, joins, catalogue):
    s = shop(spark, rental=[rental(1, 1, "2005-01-01", 20)], customer=[(1, 1, "A", "B", 1, True)], **catalogue)
    # both films called Bee count as seen
    assert rows(Recommendations(s).unseen_counts()) == [{"customer_id": 1, "category": "Animals", "num_unseen": 1}]


def test_blocks_cover_positions_in_order(spark):
    from pyspark.sql import functions as F

    out = spark.range(1, 6000).select("id", _block(F.col("id")).alias("b")).orderBy("id").collect()
    blocks = [r.b for r in out]
    assert blocks == sorted(blocks) and set(blocks) == set(range(blocks[-1] + 1))
    sizes = [blocks.count(b) for b in range(blocks[-1])]
    assert sizes == [16, 16, 32, 64, 128, 256, 512] + [1024] * (len(sizes) - 7)
