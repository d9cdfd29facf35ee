from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import kept_tiles
from marquee.operators.kept_tiles import BOUNDS, COUNTS, KeptTiles, tile_of
from tests.shops import frame

POINT = "value decimal(20,5), id long"


def points(spark, table):
    return frame(spark, [(Decimal(v), k) for k, v in table.items()], POINT)


def check(spark, kept, table, tiles):
    rows = points(spark, table)
    bounds, sorted_rows = kept.bounds(rows, tiles)
    spark.createDataFrame([(i, *b) for i, b in enumerate(bounds, 2)], BOUNDS).collect()
    window = Window.orderBy(F.desc("value"), F.asc("id"))
    both = rows.select("id", F.ntile(tiles).over(window).alias("want"), tile_of(bounds, F.col("value"), F.col("id")).alias("got"))
    wrong = both.where("want <> got").collect()
    assert not wrong, wrong[:3]
    return sorted_rows


@pytest.mark.parametrize("tiles", [10, 3])
def test_equals_ntile_after_every_change(spark, monkeypatch, tiles):
    """A hot value, values that move, rows that come and go; counts are kept and seldom cut anew."""
    monkeypatch.setattr(kept_tiles, "RANGES", 32)
    rnd = random.Random(tiles)
    table = {k: rnd.choice(["0.00", "0.00", f"{rnd.randrange(900)}.50", f"{rnd.randrange(9)}"]) for k in range(700)}
    kept = KeptTiles.cut(points(spark, table), 32)
    assert sum(kept.counts) == 700 and len(kept.counts) == 32
    sorted_rows = check(spark, kept, table, tiles)
    for _ in range(4):
        gone = dict(rnd.sample(sorted(table.items()), 40))
        come = {k: f"{rnd.randrange(1200)}.25" for k in [*rnd.sample(sorted(gone), 30), *(rnd.randrange(10**6, 10**7) for _ in range(25))]}
        kept = KeptTiles.read(spark.createDataFrame(kept.rows(), COUNTS)).changed(points(spark, gone), points(spark, come))
        table = {k: v for k, v in table.items() if k not in gone} | come
        assert sum(kept.counts) == len(table)
        sorted_rows = check(spark, kept, table, tiles)
        assert sorted_rows < len(table) / 2
    assert not kept.uneven()
    crowd = {10**8 + i: "450.75" for i in range(700)}
    assert kept.changed(points(spark, {}), points(spark, crowd)).uneven()


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 11])
def test_few_rows(spark, n):
    table = {k: str(k % 3) for k in range(n)}
    kept = KeptTiles.read(spark.createDataFrame(KeptTiles.cut(points(spark, table)).rows(), COUNTS))
    check(spark, kept, table, 10)
