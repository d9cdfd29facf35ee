from __future__ import annotations

import pytest

from marquee.llm import mixing
from tests.llm.brute import WORD


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, limit=2.0) -> dict:
    """Target by source: excess of full sources goes to the others by weight, round after round."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), {}
    while len(full) < len(order):
        rest = sum(weight[s] for s in order if s not in full)
        level = (goal - sum(full.values())) / rest
        more = {s: limit * sizes[s] for s in order if s not in full and limit * sizes[s] <= weight[s] * level}
        if not more:
            return full | {s: weight[s] * level for s in order if s not in full}
        full |= more
    return full


ROWS = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{i % 5}" if i % 11 else None) for i in range(400)]
ROWS += [(500, None, "s1"), (501, "", "empty"), (502, " \t\x0b\n", "empty"), (None, "a b", "s2"), (7, ROWS[7][1], ROWS[7][2])]
SCHEMA = "doc_id long, text string, source string"


def test_copies_follow_targets(spark):
    docs = spark.createDataFrame([(*r, 9, "x") for r in ROWS], SCHEMA + ", Size int, row string")
    sizes: dict = {}
    for _, text, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    counted = mixing.with_copies(docs, mixing.targets_of(docs)).collect()
    assert len(counted) == len(ROWS)
    for row in counted:
        assert row["size"] == len(WORD.findall(row.text or "")) and row.row == "x"
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(want[row.source])
        rate = row.target / row.source_size if row.source_size else 0
        assert int(rate) <= row.copies <= int(rate) + (rate > int(rate)) <= 2
    same = [r.copies for r in counted if r.doc_id == 7]
    assert len(same) == 2 and abs(same[0] - same[1]) <= 1
    again = mixing.with_copies(docs.repartition(5), mixing.targets_of(docs)).collect()
    assert sorted(map(str, counted)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in counted)


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('w ', cast(id % 9 + 1 as int)) text", "cast(id % 3 as string) source")
    rows = mixing.with_copies(docs, mixing.targets_of(docs)).groupBy("source").agg({"target": "max"}).collect()
    taken = {}
    for r in mixing.with_copies(docs, mixing.targets_of(docs)).collect():
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    for r in rows:
        assert taken[r.source] == pytest.approx(r["max(target)"], rel=0.05)


def test_repeated_rows_come_near_the_target_too(spark):
    """A third of all rows are one row: as many words are taken of it as of others."""
    many = spark.range(1000).selectExpr("1 doc_id", "repeat('w ', 146) text", "'hot' source", "id other")
    rest = spark.range(2000).selectExpr("id + 10 doc_id", "repeat('v ', cast(id % 9 + 1 as int)) text", "if(id % 2 = 0, 'hot', 'b') source", "id other")
    docs = many.union(rest).repartition(7)
    counted = mixing.with_copies(docs, mixing.targets_of(docs)).collect()
    assert len(counted) == 3000 and sorted(r.other for r in counted if r.doc_id == 1) == list(range(1000))
    for source in ("hot", "b"):
        mine = [r for r in counted if r.source == source]
        assert sum(r["size"] * r.copies for r in mine) == pytest.approx(mine[0].target, rel=0.02)
    hot = [r.copies for r in counted if r.doc_id == 1]
    assert max(hot) - min(hot) <= 1
    again = mixing.with_copies(docs.repartition(3), mixing.targets_of(docs)).collect()
    assert sorted((r.doc_id, r.copies) for r in counted) == sorted((r.doc_id, r.copies) for r in again)


def test_empty_tables_and_sources_without_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)
    assert [r.copies for r in mixing.with_copies(silent, mixing.targets_of(silent)).collect()] == [0, 0]


def test_given_targets_and_a_source_without_one(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], SCHEMA)
    given = spark.createDataFrame([("x", 2, 6.0)], "source string, source_size long, target double")
    assert sorted(r.doc_id for r in mixing.mix(docs, given).collect()) == [1, 1, 1]
