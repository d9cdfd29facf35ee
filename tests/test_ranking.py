from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.operators.ranking import assign_ids, row_numbers, tiles, top_k


def expected_tiles(n: int, k: int) -> list[int]:
    size, extra = divmod(n, k)
    return [tile for tile in range(1, k + 1) for _ in range(size + (tile <= extra))]


@pytest.mark.parametrize("n,k", [(1500, 10), (1497, 10), (10, 10), (7, 10), (1, 10), (101, 3), (0, 4)])
def test_tiles_equal_ntile(spark, n, k):
    # a third of the values are equal; ids break the ties
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 7 % 53).alias("v"))
    out = tiles(df, k, [F.asc("v"), F.asc("id")]).orderBy("v", "id").collect()
    assert [r.tile for r in out] == expected_tiles(n, k)


def test_row_numbers_within_hot_and_null_groups(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("g")
    )
    out = row_numbers(df, [F.desc("id")], within=["g"], name="n").collect()
    groups: dict = {}
    for row in sorted(out, key=lambda r: -r.id):
        groups.setdefault(row.g, []).append(row.n)
    assert len(out) == 900
    assert all(numbers == list(range(1, len(numbers) + 1)) for numbers in groups.values())
    assert len(groups["hot"]) == 600 and len(groups[None]) == 150


def test_a_hot_group_is_numbered_by_several_tasks(spark):
    df = spark.range(4000).select("id", F.lit("only").alias("g"))
    numbered = row_numbers(df, [F.asc("id")], within=["g"])
    assert numbered.agg(F.max("row_number")).first()[0] == 4000


def test_assign_ids_start_and_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert [tuple(r) for r in assign_ids(df, [F.asc("name")], start=5).orderBy("id").collect()] == [
        (5, "a"),
        (6, "b"),
        (7, "c"),
    ]


def test_top_k_trims_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    best = top_k(df, 3, ["g"], [F.desc("id")])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in best.collect()) == [994, 995, 996, 997, 998, 999]
