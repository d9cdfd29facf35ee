"""Load dump files into stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.changes import fill_defaults
from marquee.sources.buckets import BucketStore, Keyed
from marquee.sources.catalog import DEFAULTS, TABLES
from marquee.sources.dump_text import read_copy_table
from marquee.sources.shop import Shop

BUCKETS = 16  # of a loaded table


def with_table_defaults(df: DataFrame, table: str, now: Column) -> DataFrame:
    """Nulls of a shop table replaced by its declared defaults; ``now`` stands for the load time."""
    defaults = {
        name: now if value == "now" else F.lit(value)
        for name, value in DEFAULTS.get(table, {}).items()
        if name in df.columns
    }
    return fill_defaults(df, defaults) if defaults else df


def _store(spark: SparkSession, folder: str) -> BucketStore:
    return BucketStore(spark, folder, {name: Keyed(table.schema, table.key, BUCKETS) for name, table in TABLES.items()})


def load_shop(spark: SparkSession, files: Mapping[str, str], folder: str) -> Shop:
    """Take dump files, given as table -> path, into the tables stored below ``folder``, all in one version.

    A load that fails leaves the tables as they were. Run ``quality.check_shop`` on the result to see what breaks the
    declared rules.
    """
    unknown = set(files) - set(TABLES)
    if unknown:
        raise ValueError(f"not tables of the shop: {sorted(unknown)}")
    change = _store(spark, folder).change()
    for name, path in files.items():
        change.write(name, read_copy_table(spark, path, name))
    change.publish()
    return stored_shop(spark, folder)


def stored_shop(spark: SparkSession, folder: str, version: int | None = None) -> Shop:
    """The shop that was loaded into ``folder``, at a version, by default the newest. Tables never loaded are empty."""
    store = _store(spark, folder)
    version = store.latest() if version is None else version
    if version is None:
        raise FileNotFoundError(f"{folder} holds no loaded shop")
    return Shop(spark, {name: (lambda name=name: store.read(name, version=version)) for name in TABLES})
