"""Joins from a large table to a lookup when single keys may be very hot.

Adaptive execution reads the sizes of the shuffled partitions and splits what a hot key, or the rows without a key,
have filled; the matching lookup rows are read by every split. It does so at run time, at any scale, without looking
for hot keys first. ``marquee.session.SETTINGS`` allows it to split also where the join's partitioning is used again.
What is left for the join itself is that both sides hash a key alike, so keys are brought to their common type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}  # type -> digits


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which keys of both types compare exactly; raises where there is none."""
    if a == b:
        return a
    if type(a) in WHOLE and type(b) in WHOLE:
        return max(a, b, key=lambda t: WHOLE[type(t)])
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        sizes = []
        for kind in (a, b):
            if isinstance(kind, T.DecimalType):
                sizes.append((kind.precision - kind.scale, kind.scale))
            elif type(kind) in WHOLE:
                sizes.append((WHOLE[type(kind)], 0))
        whole, scale = (max(s) for s in zip(*sizes, strict=True))
        if len(sizes) == 2 and whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    strings = (T.StringType, T.VarcharType, T.CharType)
    if isinstance(a, strings) and isinstance(b, strings):
        return T.StringType()
    raise TypeError(f"keys of types {a.simpleString()} and {b.simpleString()} do not compare exactly")


def lookup_join(rows: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """``rows.join(lookup, on, how)``; ``how`` is one of left, inner, left_semi, left_anti.

    Key columns get the common type of both sides. Rows without a key find no partner.
    """
    on = [on] if isinstance(on, str) else list(on)
    for name in on:
        ours, theirs = rows.schema[name].dataType, lookup.schema[name].dataType
        kind = common_type(ours, theirs)
        rows = rows if ours == kind else rows.withColumn(name, F.col(name).cast(kind))
        lookup = lookup if theirs == kind else lookup.withColumn(name, F.col(name).cast(kind))
    return rows.join(lookup, on, how)
