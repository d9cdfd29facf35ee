"""Results that are kept current by changes, against the same results computed anew."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.postings import match_all_terms, token_index
from marquee.operators.ranking import running_totals
from marquee.plans import accounts, kept_index, recommend, views
from marquee.plans.kept_index import KeptIndex
from marquee.plans.kept_sales import KeptSales, signed
from marquee.plans.recommend import Recommendations
from marquee.plans.snapshots import SnapshotTable
from marquee.sources.buckets import Change, Keyed
from tests.shops import COLUMNS, at, film, frame, payment, rental, rows, shop

FILMS = dict(
    film=[film(n, f"F{n}") for n in (1, 2, 3)],
    inventory=[(10, 1, 1), (11, 1, 2), (20, 2, 1), (30, 3, 2), (40, None, 2)],
    category=[(1, "Action"), (2, "Comedy"), (3, "Empty")],
    customer=[(c, 1, f"C{c}", "X", 1, True) for c in (1, 2, 3)],
    staff=[(1, "Ann", "A", 1, 1), (2, "Bob", "B", 2, 2)], store=[(1, 1, 1), (2, 2, 2)],
    address=[(1, "a", "1", "1", 1), (2, "b", "2", "2", 1)], city=[(1, "Town", 1)], country=[(1, "Land")],
)


def same(kept, whole) -> None:
    assert sorted(map(str, rows(kept))) == sorted(map(str, rows(whole)))


def test_sales_after_inserts_updates_and_deletes(spark, tmp_path):
    """Rentals, payments and the films' categories change at random; payments come before their rentals and after."""
    rnd = random.Random(6)
    rentals = {n: rental(n, n % 3 + 1, "2005-01-01", rnd.choice([10, 11, 20, 30, 40, None])) for n in range(1, 30)}
    payments = {n: payment(n, rnd.randrange(1, 36), f"{rnd.randrange(900)}.25") for n in range(1, 40)}
    filed = {(1, 1), (2, 1), (3, 2), (3, 1)}

    def now():
        return shop(spark, rental=list(rentals.values()), payment=list(payments.values()), film_category=sorted(filed), **FILMS)

    before = now()
    kept = KeptSales(before, str(tmp_path / "sales"), buckets=2)
    kept.start()
    for step in range(2):
        for n in rnd.sample(sorted(rentals), 6):
            if rnd.random() < 0.4:
                del rentals[n]
            else:
                rentals[n] = rental(n, n % 3 + 1, "2005-01-01", rnd.choice([10, 11, 20, 30]))
        rentals |= {n: rental(n, 1, "2005-02-01", rnd.choice([10, 20, 30])) for n in range(30 + 3 * step, 33 + 3 * step)}
        for n in rnd.sample(sorted(payments), 6):
            payments.pop(n)
        payments |= {100 * (step + 1) + n: payment(n, rnd.randrange(1, 36), f"{rnd.randrange(900)}.50") for n in range(8)}
        filed ^= {(1, 1), (1, 2)} if step == 0 else {(3, 2), (3, 3), (2, 1)}
        after = now()
        kept.change(
            signed(before.rental, after.rental, ["rental_id", "inventory_id"]),
            signed(before.payment, after.payment, ["rental_id", "amount"]),
            signed(before.film_category, after.film_category, ["film_id", "category_id"]),
        )
        before = after
        same(kept.by_category().selectExpr("category", "cast(total_sales as decimal(28,2)) t"),
             views.sales_by_category(after).selectExpr("category", "cast(total_sales as decimal(28,2)) t"))
        same(kept.by_store().selectExpr("store", "manager", "cast(total_sales as decimal(28,2)) t"),
             views.sales_by_store(after).selectExpr("store", "manager", "cast(total_sales as decimal(28,2)) t"))


@pytest.mark.parametrize("replacement", [False, True])
def test_balances_at_many_dates_equal_one_run_per_date(spark, replacement):
    rnd = random.Random(1)
    moments = [f"2005-0{m}-{d:02d}" for m in (1, 2, 3) for d in (1, 9, 17)]
    rented = [rental(n, rnd.choice([1, 1, 1, 1, 2]), rnd.choice(moments), rnd.choice([10, 20, 30]), rnd.choice([None, "2005-03-20", "2005-03-01"])) for n in range(1, 60)]
    paid = [payment(n, n, f"{rnd.randrange(9)}.99", rnd.choice([1, 2, 3]), rnd.choice(moments)) for n in range(1, 60)]
    s = shop(spark, rental=rented, payment=paid, **FILMS)
    asked = [(c, at(d)) for c in (1, 2, 3, 99) for d in [*moments[::2], "2004-01-01", "2006-01-01T12:00:00"]]
    many = accounts.customer_balances(s, frame(spark, [*asked, asked[0], (1, None)], "customer_id int, as_of timestamp_ntz"), replacement)
    found = {(r["customer_id"], r["as_of"]): r["balance"] for r in rows(many)}
    assert len(rows(many)) == len(found) == len([a for a in asked if a[0] != 99])
    for day in sorted({d for _, d in asked}):
        single = {r["customer_id"]: r["balance"] for r in rows(accounts.customer_balance(s, str(day), replacement))}
        assert {c: found[c, day] for c in (1, 2, 3)} == single


def test_running_totals_carry_over_partitions(spark):
    """A hot group fills several range partitions; nulls count as nothing."""
    data = spark.range(4000).selectExpr("if(id % 4 < 3, 'hot', cast(id % 7 as string)) g", "id", "if(id % 5 = 0, null, id % 11) v")
    out = running_totals(data.repartition(6), "v", [F.asc("id")], ["g"], "total").collect()
    sums: dict = {}
    for row in sorted(out, key=lambda r: r["id"]):
        sums[row["g"]] = sums.get(row["g"], 0) + (row["v"] or 0)
        assert row["total"] == sums[row["g"]], row
    assert len(out) == 4000


def test_postings_follow_their_texts(spark, tmp_path):
    texts = {n: f"common word{n % 3} rare{n}" for n in range(40)} | {100: None, 101: "", 102: "common common"}
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=16)

    def docs(some):
        return frame(spark, sorted(some.items()), "doc_id long, text string")

    def check():
        whole = token_index(docs(texts))
        same(index.postings().select("term", "doc_id", "tf"), whole.select("term", "doc_id", "tf"))
        for terms in (["common"], ["Common", "word1"], ["common", "rare5", "word2"], ["nowhere", "common"], ["changed", "common"], []):
            want = match_all_terms(whole, terms) if terms else whole.select("doc_id", "tf").limit(0)
            same(index.match_all_terms(terms), want)

    index.update(docs(texts))
    changed = {5: "changed common text", 6: "", 50: "word1 common new"}
    texts |= changed
    del texts[7]
    index.update(docs(changed), gone=docs({7: ""}))
    check()
    before = set(index.store.files("postings"))
    index.tidy()
    check()
    assert set(index.store.files("postings")).isdisjoint(before)
    read = set(index.of_terms(["rare5"]).inputFiles())
    assert 0 < len(read) < len(index.store.files("postings")) / 4


def test_snapshots_are_taken_in_by_their_differences(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType()), T.StructField("n", T.IntegerType()),
                           T.StructField("last_update", T.IntegerType())])
    table = SnapshotTable(spark, str(tmp_path / "t"), Keyed(schema, ("k",), 50))
    plain: dict = {}
    state = {k: (f"v{k % 3}", k if k % 4 else None) for k in range(200)}
    for step in range(3):
        taken = table.take(spark.createDataFrame([(k, *v) for k, v in sorted(state.items(), reverse=step % 2 == 1)], "k long, v string, n int"), F.lit(step))
        want = {k: (*v, plain[k][2] if k in plain and plain[k][:2] == v else step) for k, v in state.items()}
        changes = {k: "new" if k not in plain else "different" for k in state if want[k][2] == step} | {k: "gone" for k in plain if k not in state}
        assert {r["k"]: r["change"] for r in taken.changes.collect()} == changes
        assert {r["k"]: tuple(r)[1:] for r in table.read().collect()} == want
        assert len(taken.buckets) <= len(changes)
        plain, files = want, set(table.store.files("rows"))
        state = {k: v for k, v in state.items() if k != 3} | {5: (None, 5), 9: ("x", None), 1000: ("new", 1)} if step == 0 else state
    assert set(table.store.files("rows")) == files and taken.buckets == set()  # the same snapshot in another order


def test_unseen_titles_factored(spark):
    rnd = random.Random(9)
    films = [film(n, f"T{n % 17}", f"{n % 5}.99") for n in range(1, 21)]
    s = shop(
        spark, film=films, inventory=[(n, n, 1) for n in range(1, 21)], category=[(1, "A"), (2, "B")],
        film_category=[(n, n % 2 + 1) for n in range(1, 21)], customer=FILMS["customer"],
        rental=[rental(n, rnd.choice([1, 1, 2]), "2005-01-01", rnd.choice([*range(1, 21), None])) for n in range(1, 40)],
    )
    found = Recommendations(s).factored()
    same(found.expand(), Recommendations(s).unseen_of(s.customer).select("customer_id", "category", "title", "film_id"))
    one = frame(spark, [(1,)], "customer_id int")
    same(found.expand(one), found.expand().where("customer_id = 1"))
    same(found.counts(), Recommendations(s).unseen_counts())
    assert sum(len(rows(t)) for t in (found.wanted, found.shelves, found.seen)) < 80


def test_unseen_titles_are_not_shuffled_once_met(spark, monkeypatch):
    monkeypatch.setattr(recommend, "UNIT_FILMS", 3)
    monkeypatch.setattr(recommend, "UNIT_CUSTOMERS", 2)
    films = [film(n, f"T{n % 7}" if n % 9 else None, f"{n % 5}.99") for n in range(1, 23)]
    lent = [(c, (c * 5 + n * 3) % 22 + 1) for c in range(1, 8) for n in range(c)]
    s = shop(
        spark, film=films, inventory=[(n, n, 1) for n in range(1, 23)], category=[(1, "A"), (2, "B")],
        film_category=[(n, n % 2 + 1) for n in range(1, 23)], customer=[(c, 1, "X", f"Y{c}", 1, True) for c in range(1, 8)],
        rental=[rental(n, c, "2005-01-01", copy) for n, (c, copy) in enumerate(lent)],
    )
    title, category = {f[0]: f[1] for f in films}, {f[0]: "AB"[f[0] % 2] for f in films}
    want = []
    for c in range(1, 8):
        counts = Counter(category[copy] for who, copy in lent if who == c)
        seen = {title[copy] for who, copy in lent if who == c} - {None}
        best = {name for name, n in counts.items() if n == max(counts.values())}
        want += [(c, category[f], title[f], f) for f in title if category[f] in best and title[f] not in seen]
    shown = Recommendations(s).factored().expand()
    assert sorted(map(str, map(tuple, shown.collect()))) == sorted(map(str, want))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Exchange")
    of = Recommendations(s).unseen_of(s.customer.where("customer_id > 4")).select(*shown.columns)
    assert sorted(map(str, map(tuple, of.collect()))) == sorted(str(row) for row in want if row[0] > 4)


def test_unseen_titles_are_written_in_runs(spark, monkeypatch):
    """Seen films stand at the ends of blocks, side by side, twice under one title, or fill a block; one customer is null."""
    monkeypatch.setattr(recommend, "UNIT_FILMS", 4)
    monkeypatch.setattr(recommend, "UNIT_CUSTOMERS", 2)
    shelf = {n: {3: "T1", 7: None}.get(n, f"T{n}") for n in range(1, 15)}  # its places are those of the numbers
    seen = {1: [1], 2: [4, 5], 3: [5, 6, 8], 4: [9, 10, 11, 12], 5: [13, 14], 6: [*shelf], 7: [2], 8: [40], None: [2]}
    lent = [(c, n) for c, numbers in seen.items() for n in numbers]
    s = shop(
        spark, film=[film(n, t) for n, t in shelf.items()] + [film(40, "Other")], inventory=[(n, n, 1) for n in (*shelf, 40)],
        category=[(1, "A"), (2, "B")], film_category=[*((n, 1) for n in shelf), (40, 2)], customer=FILMS["customer"],
        rental=[rental(n, c, "2005-01-01", copy) for n, (c, copy) in enumerate(lent)],
    )
    shown = Recommendations(s).factored().settled().expand()
    want = []
    for c, numbers in seen.items():
        titles = {shelf.get(n) for n in numbers if c is not None} - {None}
        want += [(c, "A", t, n) for n, t in shelf.items() if c != 8 and t not in titles]
    assert sorted(map(str, map(tuple, shown.collect()))) == sorted(map(str, want))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    written = plan[plan.index("Generate inline") :].split("\n")[0]
    assert "slice(" in written and "lambda" not in written  # no film is asked who has seen it


def test_sums_are_added_without_looking_for_keys(spark, tmp_path, monkeypatch):
    replaced, replace = [], Change.replace
    monkeypatch.setattr(Change, "replace", lambda self, table, *rest: (replaced.append(table), replace(self, table, *rest))[1])
    s = shop(spark, **FILMS, film_category=[(1, 1), (2, 2)], rental=[rental(1, 1, "2005-01-01", 10)], payment=[payment(1, 1, "2.00"), payment(2, 1, "3.00")])
    kept = KeptSales(s, str(tmp_path / "sales"), buckets=4)
    kept.start()
    gone = frame(spark, [(1, Decimal("3.00"), -1)], "rental_id int, amount decimal(18,2), sign int")
    kept.change(payments=gone)
    assert set(replaced) == {"rentals"}
    assert [tuple(r) for r in kept.store.read("by_film").collect()] == [(1, Decimal("2.00"), 1)]
    kept.change(payments=frame(spark, [(1, Decimal("2.00"), -1)], "rental_id int, amount decimal(18,2), sign int"))
    assert kept.store.read("by_film").isEmpty() and kept.store.read("paid").isEmpty()


def test_postings_are_written_once(spark, tmp_path, monkeypatch):
    written, settled = [], kept_index.settle
    monkeypatch.setattr(kept_index, "settle", lambda df, label: (written.append(label), settled(df, label))[1])
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=4)
    index.update(frame(spark, [(1, "red ink"), (2, "red")], "doc_id long, text string"))
    index.update(frame(spark, [(2, "ink")], "doc_id long, text string"))
    assert "postings" not in written
    assert sorted(map(tuple, index.postings().collect())) == [("ink", 1, 1), ("ink", 2, 1), ("red", 1, 1)]
    assert sorted(map(tuple, index.store.read("terms").groupBy("term").agg(F.sum("texts")).collect())) == [("ink", 2), ("red", 2)]
