"""Result tables kept as numbered versions, published after they are complete.

``<table>/data/<part>`` holds rows, and the log (``marquee.sources.log``) says which parts make up a version. Nothing that
was published is written again: a repeated write goes to a part of its own, and the last attempt at a version counts.
Readers hold the files of the attempt they found. A job that fails half way leaves nothing visible. Appending adds a
part; the rows so far stay where they are, and ``merge`` puts small parts together. A table has one writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.settle import delete_path
from marquee.operators.skew import lookup_join
from marquee.sources.log import State, VersionLog, folder_names

NAME, WHOLE = "rows", 0  # the one table and bucket of its log


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns, order and types of ``schema``.

    A value that does not fit its type, or a null in a column declared not
    null, stops the write.
    """
    missing = set(schema.names) ^ set(df.columns)
    if missing:
        raise ValueError(f"columns do not match the table: {sorted(missing)}")
    columns = []
    for field in schema.fields:
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(
                value, F.raise_error(F.lit(f"{field.name} must not be null")).cast(field.dataType)
            )
        columns.append(value.alias(field.name))
    return df.select(*columns)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.log = VersionLog(spark, f"{path}/log")

    def _parts(self, state: State) -> list[str]:
        return state.buckets.get(NAME, {}).get(WHOLE, [])

    def _add_part(self, df: DataFrame, version: int) -> str:
        part = f"{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{part}")
        return part

    def latest(self) -> int | None:
        """Newest published version; None before the first."""
        return self.log.state().version

    def read(self, version: int | None = None) -> DataFrame:
        state = self.log.state(version)
        if state.version is None:
            raise FileNotFoundError(f"{self.path} has no published version" + ("" if version is None else f" {version}"))
        return self.spark.read.parquet(*[f"{self.path}/data/{part}" for part in self._parts(state)])

    def write(self, df: DataFrame, schema: T.StructType | None = None, version: int | None = None) -> int:
        """Replace the table's content; returns the version written.

        Writing a version again makes a new attempt at it, which makes retries harmless.
        """
        if version is None:
            last = self.latest()
            version = 0 if last is None else last + 1
        if schema is not None:
            df = fit_schema(df, schema)
        anew = {NAME: {WHOLE: [self._add_part(df, version)]}}
        self.log.publish(version, State(version, anew), {}, anew)
        return version

    def append(self, df: DataFrame) -> int:
        """A new version: the parts so far, and one with the rows of ``df``, which has the table's columns."""
        state = self.log.state()
        if state.version is None:
            return self.write(df)
        version = state.version + 1
        part = self._add_part(fit_schema(df, self.read().schema), version)
        after = State(version, {NAME: {WHOLE: [*self._parts(state), part]}})
        self.log.publish(version, after, {NAME: {WHOLE: [part]}}, {})
        return version

    def merge(self, most: int = 1) -> int | None:
        """A new version of the same rows in one part, if there are more than ``most``; Spark sizes its files."""
        state = self.log.state()
        if len(self._parts(state)) <= most:
            return state.version
        return self.write(self.read(state.version).hint("rebalance"))

    def delete_using(self, other: DataFrame, on: list[str]) -> int:
        """A new version without the rows that have a partner in ``other``."""
        return self.write(lookup_join(self.read(), other.select(*on).distinct(), on, "left_anti"))

    def keep_last(self, count: int) -> None:
        """Delete the parts that none of the newest ``count`` versions needs, and entries of eras before them."""
        needed = self.log.needed(count)
        if needed is None:
            return
        parts, era = needed
        for part in folder_names(self.spark, f"{self.path}/data"):
            if (NAME, part) not in parts:
                delete_path(self.spark, f"{self.path}/data/{part}")
        self.log.forget(era)
