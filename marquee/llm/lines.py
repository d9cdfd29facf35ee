"""Line dedup by site-relative frequency.

A line is boilerplate on a host if more than ``ratio`` of the host's pages hold it. Lines are counted as 96-bit hashes
with map-side aggregation: a page adds a line once, a host with a third of the pages arrives as one row per line and
task. A host has at most (lines per page / ratio) boilerplate lines, so they fit one array per host; that table is
written, and Spark broadcasts it only if its size allows, else both sides are shuffled and skewed hosts split.

Defined results: lines are compared after trimming spaces, tabs and carriage returns; blank lines are kept and never
counted; a line on a single page of its host is never boilerplate, since nothing repeats; a null host is a host of its own; a null text stays null, an empty one empty; a text that loses all lines
becomes empty and its row stays; equal rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed, unpacked
from marquee.operators.settle import settle

REPEATED = 2  # pages that make a repetition


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """What is compared of a line: two hashes of its trimmed form; null for a blank line."""
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.when(trimmed != "", F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = REPEATED) -> DataFrame:
    """Per ``host`` the ``marks`` of lines on more than ``ratio`` of its pages, and on ``min_pages`` or more."""
    pages = docs.select(F.col(host).alias("host"), F.col("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    marks = F.array_distinct(F.transform(_lines(F.col("text")), _mark))
    held = (
        pages.select("host", F.explode(marks).alias("mark"))
        .where(F.col("mark").isNotNull())
        .groupBy("host", "mark")
        .agg(F.count(F.lit(1)).alias("held"))
        .where(F.col("held") >= min_pages)
    )
    totals = totals.select(F.col("host").alias("of"), "pages")
    return (
        held.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("held") > F.col("pages") * F.lit(ratio))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = REPEATED
) -> DataFrame:
    """``docs`` with ``text`` without boilerplate lines, ``n_lines`` before and ``n_dropped``."""
    bad = settle(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    bad = bad.select(F.col("host").alias("of"), "marks")
    rows = packed(docs, host=F.col(host), text=F.col("text"))
    joined = rows.join(bad, F.col("host").eqNullSafe(F.col("of")), "left")
    lines = joined.withColumn("lines", _lines(F.col("text")))
    kept = F.filter("lines", lambda line: ~F.coalesce(F.array_contains(F.col("marks"), _mark(line)), F.lit(False)))
    lines = lines.withColumn("kept", F.when(F.col("marks").isNull(), F.col("lines")).otherwise(kept))
    n_lines = F.coalesce(F.size("lines"), F.lit(0))
    done = lines.select(
        "row",
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("kept")).cast("long").alias("n_dropped"),
    )
    return unpacked(done, docs, "text", "n_lines", "n_dropped")
