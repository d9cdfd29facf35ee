from __future__ import annotations

import random
from datetime import date
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from marquee.functions.exact import round_ratio
from marquee.functions.text import compact_name, full_name, group_concat, last_day
from tests.shops import at


def rounded(n: int, d: int, scale: int):
    if d == 0:
        return None
    with localcontext() as context:
        context.prec = 80
        return (Decimal(n) / Decimal(d)).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)


def test_round_ratio_is_exact(spark):
    rng = random.Random(3)
    pairs = [(1, 8), (-1, 8), (1, -8), (5, 1000), (-5, 1000), (1005, 1000), (7, 0), (0, 3), (23, 40)]
    pairs += [(rng.randint(-(10**12), 10**12), rng.choice([1, 3, 8, 16, 40, 86400, -7])) for _ in range(500)]
    df = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(pairs)], "i int, n long, d long")
    out = df.select("n", "d", round_ratio(F.col("n"), F.col("d"), 2).alias("r")).collect()
    for row in out:
        assert row.r == rounded(row.n, row.d, 2), row


def test_names(spark):
    df = spark.createDataFrame([("mARY", "o'NEIL"), (None, "X")], "a string, b string")
    out = df.select(full_name("a", "b").alias("f"), compact_name("a", "b").alias("c")).collect()
    assert tuple(out[0]) == ("mARY o'NEIL", "MaryO'neil")
    assert tuple(out[1]) == (None, None)


def test_group_concat_skips_nulls(spark):
    df = spark.createDataFrame(
        [(1, "b"), (1, None), (1, "a"), (1, "b"), (2, None)], "g int, x string"
    )
    out = {
        r.g: (r.x, r.d)
        for r in df.groupBy("g").agg(group_concat("x").alias("x"), group_concat("x", True).alias("d")).collect()
    }
    assert out == {1: ("a, b, b", "a, b"), 2: (None, None)}


def test_last_day(spark):
    df = spark.createDataFrame([(at("2004-02-03"),), (at("2005-12-31T23:59"),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(last_day("t")).collect()] == [date(2004, 2, 29), date(2005, 12, 31), None]
