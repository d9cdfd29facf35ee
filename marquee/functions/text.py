"""Name and list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.sources.catalog import RATINGS


def full_name(first: str, last: str) -> Column:
    """First and last name with a blank; null when either is missing."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def capitalised(name: str) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.expr(f"substring({name}, 2)")))


def compact_name(first: str, last: str) -> Column:
    """Both names capitalised and joined without a blank."""
    return F.concat(capitalised(first), capitalised(last))


def group_concat(column: str, distinct: bool = False) -> Column:
    """Sorted comma-joined text of a group; nulls are skipped, none left is null."""
    what = f"DISTINCT {column}" if distinct else column
    return F.expr(f"listagg({what}, ', ') WITHIN GROUP (ORDER BY {column})")


def rating_rank(column: str) -> Column:
    """Place of a rating in the ratings' own order, which is not alphabetical."""
    place = F.array_position(F.array(*[F.lit(rating) for rating in RATINGS]), F.col(column))
    return F.when(place > 0, place.cast("int"))


def last_day(moment: str) -> Column:
    """Last date of the month a timestamp falls in."""
    return F.last_day(F.col(moment))
