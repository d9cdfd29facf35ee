"""Tiles (``ntile``) of a changing table from kept counts, without sorting the table again.

Rows are ordered by a value, highest first, then by id. The order is cut into some hundred ranges; kept is how many rows
each holds. A change takes its old rows out of the counts and puts its new ones in. The first row of every tile is then
found from the counts: they name the range it lies in and its place there, and only the rows of these ranges, one per
tile at most, are read and sorted. A row's tile is one more than the number of tiles that begin at or after the first
and not behind it, so no row carries its tile and none is rewritten when a bound moves.

Ranges are cut anew, with one sort of the table, when the largest has outgrown the average ``UNEVEN`` times.

The driver holds the ranges and the bounds, numbers that do not grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.ranking import row_numbers

RANGES = 256
UNEVEN = 4  # times the average that a range may hold
LEAST = 64  # rows of a range below which nothing is cut anew

COUNTS = T.StructType(
    [
        T.StructField("range", T.IntegerType(), False),
        T.StructField("value", T.DecimalType(20, 5)),
        T.StructField("id", T.LongType()),
        T.StructField("n", T.LongType(), False),
    ]
)
BOUNDS = T.StructType(
    [
        T.StructField("tile", T.IntegerType(), False),
        T.StructField("value", T.DecimalType(20, 5), False),
        T.StructField("id", T.LongType(), False),
    ]
)
Point = tuple  # (value, id): where a range or a tile begins


def _value(value) -> Column:
    return F.lit(value).cast(COUNTS["value"].dataType)


def _from(point: Point, value: Column, id_: Column) -> Column:
    """Whether a row stands at ``point`` or behind it."""
    return (value < _value(point[0])) | ((value == _value(point[0])) & (id_ >= F.lit(point[1])))


def tile_of(bounds: Sequence[Point], value: Column, id_: Column) -> Column:
    """The tile of a row, from the first rows of the tiles after the first."""
    tile = F.lit(1)
    for point in bounds:
        tile = tile + _from(point, value, id_).cast("int")
    return tile


def _order() -> list[Column]:
    return [F.desc("value"), F.asc("id")]


@dataclass(frozen=True)
class KeptTiles:
    """Where the ranges after the first begin, and how many rows each holds."""

    starts: tuple[Point, ...]
    counts: tuple[int, ...]

    @classmethod
    def cut(cls, rows: DataFrame, ranges: int = RANGES) -> KeptTiles:
        """Ranges of equal size from ``rows`` (value, id); sorts them all once, over many tasks."""
        numbered = row_numbers(rows.select("value", "id"), _order(), name="place", total="of")
        size = F.greatest(F.ceil(F.col("of") / ranges), F.lit(1))
        first = numbered.where((F.col("place") - 1) % size == 0)
        found = first.orderBy("place").select("value", "id", "place", "of").collect()  # a row per range
        if not found:
            return cls((), (0,))
        ends = [row["place"] - 1 for row in found[1:]] + [found[0]["of"]]
        counts = tuple(end - row["place"] + 1 for end, row in zip(ends, found, strict=True))
        return cls(tuple((row["value"], row["id"]) for row in found[1:]), counts)

    @classmethod
    def read(cls, table: DataFrame) -> KeptTiles:
        rows = sorted(table.collect(), key=lambda r: r["range"])  # a row per range
        return cls(tuple((r["value"], r["id"]) for r in rows[1:]), tuple(r["n"] for r in rows) or (0,))

    def rows(self) -> list[tuple]:
        """The rows of a table with the schema ``COUNTS``."""
        return [(i, *point, n) for i, (point, n) in enumerate(zip(((None, None), *self.starts), self.counts, strict=True))]

    def _range(self, value: Column, id_: Column) -> Column:
        """The range of a row: the number of starts up to it, found through every sixteenth of them first."""
        step = 16
        points = F.array(*[F.struct((-_value(v)).alias("v"), F.lit(i).cast("long").alias("i")) for v, i in self.starts])
        if not self.starts:
            return F.lit(0)
        mine = F.struct((-value.cast(COUNTS["value"].dataType)).alias("v"), id_.cast("long").alias("i"))
        coarse = F.array(*[F.struct((-_value(v)).alias("v"), F.lit(i).cast("long").alias("i")) for v, i in self.starts[::step]])
        passed = F.size(F.filter(coarse, lambda p: p <= mine))
        near = F.slice(points, F.greatest((passed - 1) * step + 1, F.lit(1)), F.lit(step))
        return F.when(passed == 0, 0).otherwise((passed - 1) * step + F.size(F.filter(near, lambda p: p <= mine)))

    def changed(self, gone: DataFrame, come: DataFrame) -> KeptTiles:
        """The counts without the rows ``gone`` and with those that ``come`` (value, id)."""
        signed = gone.select("value", "id", F.lit(-1).alias("s")).unionByName(come.select("value", "id", F.lit(1).alias("s")))
        sums = signed.groupBy(self._range(F.col("value"), F.col("id")).alias("range")).agg(F.sum("s").alias("s"))
        counts = list(self.counts)
        for row in sums.collect():  # a row per range
            counts[row["range"]] += row["s"]
        return KeptTiles(self.starts, tuple(counts))

    def uneven(self) -> bool:
        return max(self.counts) > max(LEAST, UNEVEN * sum(self.counts) / max(len(self.counts), RANGES))

    def bounds(self, rows: DataFrame, tiles: int) -> tuple[list[Point], int]:
        """The first rows of the tiles after the first, and how many of ``rows`` were sorted to find them."""
        total = sum(self.counts)
        wanted: dict[int, list[int]] = {}  # range -> places within it
        for tile in range(1, tiles):
            place = tile * (total // tiles) + min(tile, total % tiles)
            if place < total:
                at = 0
                while place >= self.counts[at]:
                    place -= self.counts[at]
                    at += 1
                wanted.setdefault(at, []).append(place + 1)
        if not wanted:
            return [], 0
        inside = F.lit(False)
        for at in wanted:
            this = F.lit(True) if at == 0 else _from(self.starts[at - 1], F.col("value"), F.col("id"))
            if at < len(self.starts):
                this = this & ~_from(self.starts[at], F.col("value"), F.col("id"))
            inside = inside | this
        some = rows.select("value", "id").where(inside).withColumn("range", self._range(F.col("value"), F.col("id")))
        numbered = row_numbers(some, _order(), within=["range"], name="place")
        asked = F.lit(False)
        for at, places in wanted.items():
            asked = asked | ((F.col("range") == at) & F.col("place").isin(places))
        found = numbered.where(asked).collect()  # a row per tile
        points = sorted(((row["value"], row["id"]) for row in found), key=lambda p: (-p[0], p[1]))
        return points, sum(self.counts[at] for at in wanted)
