from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.skew import common_type, lookup_join

HOW = ["left", "inner", "left_semi", "left_anti"]


def facts(spark, n=6000, kind="long"):
    """A third of the rows under key 7, a tenth without a key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id") % 997)
    return spark.range(0, n, 1, 8).select(F.col("id").alias("n"), key.cast(kind).alias("k"), (F.col("id") % 5).alias("j"))


def lookup(spark, kind="long"):
    return spark.range(0, 900).select(F.col("id").cast(kind).alias("k"), (F.col("id") * 2).alias("v"))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("how", HOW)
def test_join_equals_plain_join(spark, joins, how):
    same(lookup_join(facts(spark), lookup(spark), "k", how), facts(spark).join(lookup(spark), "k", how))


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("ours,theirs", [("int", "long"), ("long", "int"), ("short", "decimal(12,3)"), ("decimal(9,1)", "decimal(12,3)")])
def test_keys_of_different_types_meet(spark, joins, how, ours, theirs):
    found = lookup_join(facts(spark, kind=ours), lookup(spark, kind=theirs), "k", how)
    plain = lookup_join(facts(spark), lookup(spark), "k", how)
    assert found.count() == plain.count()
    same(found.drop("k"), plain.drop("k"))


def test_types_without_a_common_one_are_refused():
    assert common_type(T.DecimalType(10, 2), T.LongType()) == T.DecimalType(22, 2)
    for other in (T.DoubleType(), T.StringType(), T.DecimalType(38, 30)):
        with pytest.raises(TypeError):
            common_type(T.LongType(), other)


def test_join_with_several_matches_and_two_keys(spark, joins):
    a = facts(spark, 1500)
    b = spark.range(0, 60).select((F.col("id") % 20).alias("k"), (F.col("id") % 5).alias("j"), F.col("id").alias("v"))
    ours, plain = lookup_join(a, b, ["k", "j"], "inner"), a.join(b, ["k", "j"], "inner")
    assert ours.count() == plain.count() > 0
    same(ours, plain)


@pytest.mark.parametrize("how", HOW)
def test_only_missing_keys_are_hot(spark, joins, how):
    a = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"))
    same(lookup_join(a, lookup(spark), "k", how), a.join(lookup(spark), "k", how))


def test_a_hot_key_is_split_also_before_a_grouping_by_it(spark):
    from check import SPLIT_ALL

    before = {key: spark.conf.get(key, None) for key in SPLIT_ALL}
    for key, value in SPLIT_ALL.items():
        spark.conf.set(key, value)
    try:
        joined = lookup_join(facts(spark, 200_000), lookup(spark), "k", "inner").groupBy("k").agg(F.sum("v").alias("v"))
        assert joined.where("k = 7").first()["v"] > 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
