"""Keyed tables in hash buckets, which change together, one version after the other.

A table's rows lie in buckets by a hash of their key, a folder per bucket and part; the log (``marquee.sources.log``) says
which parts a bucket has. A change reads and rewrites the buckets of the keys it touches, or adds a part to them, and
nothing of the others; several tables change in one entry of the log, so no reader sees one without the other. Readers
who name keys read those keys' buckets only. Files of older versions stay until ``keep_last``.

How much a change rewrites follows from the number of buckets: a table has many more of them than a change has keys, or
most are touched. A bucket's rows are written by as many tasks as their size needs, so a hot key is split.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.settle import delete_path, passing, settle
from marquee.operators.skew import lookup_join
from marquee.sources.log import Buckets, State, VersionLog, folder_names
from marquee.sources.versions import fit_schema

BUCKET = "_bucket"


@dataclass(frozen=True)
class Keyed:
    """A declared table. Key columns are declared not null; rows of a key lie together, there may be several.

    Files are sorted by ``order``, so that readers who look for values of it skip row groups.
    """

    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64
    order: tuple[str, ...] = ()

    def bucket(self) -> Column:
        typed = [F.col(name).cast(self.schema[name].dataType) for name in self.key]
        return F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int")


class BucketStore:
    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Keyed], era: int = 32):
        self.spark, self.path, self.tables = spark, path, dict(tables)
        self.log = VersionLog(spark, f"{path}/log", era)

    def latest(self) -> int | None:
        """Newest published version; None before the first."""
        return self.log.state().version

    def buckets_of(self, table: str, keys: DataFrame) -> set[int]:
        """The buckets that ``keys`` (the key's columns) lie in, as many numbers at most as there are buckets."""
        return {row[0] for row in keys.select(self.tables[table].bucket()).distinct().collect()}

    def _scan_state(self, table: str, state: State, buckets: set[int] | None = None) -> DataFrame:
        held = state.buckets.get(table, {})
        paths = [f"{self.path}/data/{table}/{p}" for b in sorted(held) if buckets is None or b in buckets for p in held[b]]
        schema = self.tables[table].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, touching: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """A table at a version, by default the newest; of it the rows of the keys ``touching``."""
        state = self.log.state(version)
        if version is not None and state.version is None:
            raise FileNotFoundError(f"{self.path} has no published version {version}")
        return self._read(table, state, touching)

    def _read(self, table: str, state: State, touching: DataFrame | None) -> DataFrame:
        if touching is None or not any(state.buckets.get(table, {}).values()):
            return self._scan_state(table, state)
        key = list(self.tables[table].key)
        keys = touching.select(*key).distinct()
        return lookup_join(self._scan_state(table, state, self.buckets_of(table, keys)), keys, key, "left_semi")

    def scan(self, table: str, buckets: set[int], version: int | None = None) -> DataFrame:
        """The rows of some buckets."""
        return self._scan_state(table, self.log.state(version), buckets)

    def files(self, table: str, version: int | None = None) -> list[str]:
        """Files of a table at a version."""
        return sorted(self._scan_state(table, self.log.state(version)).inputFiles())

    def change(self, version: int | None = None) -> Change:
        """A change that becomes ``version``, by default the next; it starts from the newest version before."""
        state = self.log.state(before=version)
        return Change(self, state, version if version is not None else (0 if state.version is None else state.version + 1))

    def keep_last(self, count: int) -> None:
        """Delete what none of the newest ``count`` versions needs. Not while a change is under way."""
        needed = self.log.needed(count)
        if needed is None:
            return
        parts, era = needed
        for table in folder_names(self.spark, f"{self.path}/data"):
            kept = {part for name, part in parts if name == table}
            folders = {part.split("/")[0] for part in kept}
            for folder in folder_names(self.spark, f"{self.path}/data/{table}"):
                at = f"{self.path}/data/{table}/{folder}"
                if folder not in folders:
                    delete_path(self.spark, at)
                    continue
                for name in folder_names(self.spark, at):
                    if name.startswith(BUCKET) and f"{folder}/{name}" not in kept:
                        delete_path(self.spark, f"{at}/{name}")
        self.log.forget(era)


class Change:
    """What will be the next version. Files are written at once, and seen by others when it is published."""

    def __init__(self, store: BucketStore, state: State, version: int):
        self.store, self.version = store, version
        self.state = state.copy()
        self.added: Buckets = {}
        self.anew: Buckets = {}

    def read(self, table: str, touching: DataFrame | None = None) -> DataFrame:
        """A table as this change has made it so far."""
        return self.store._read(table, self.state, touching)

    def scan(self, table: str, buckets: set[int] | None) -> DataFrame:
        """The rows of some buckets, or of all, as this change has made them so far."""
        return self.store._scan_state(table, self.state, buckets)

    def _written(self, table: str, rows: DataFrame) -> dict[int, str]:
        """A new part with ``rows``: the folder of every bucket that has any."""
        spec, folder = self.store.tables[table], f"{self.version}-{uuid.uuid4().hex}"
        path = f"{self.store.path}/data/{table}/{folder}"
        placed = fit_schema(rows, spec.schema).withColumn(BUCKET, spec.bucket())
        placed = placed.hint("rebalance", F.col(BUCKET))
        if spec.order:
            placed = placed.sortWithinPartitions(BUCKET, *spec.order)
        placed.write.partitionBy(BUCKET).parquet(path)
        names = [name for name in folder_names(self.store.spark, path) if name.startswith(f"{BUCKET}=")]
        return {int(name.split("=")[1]): f"{folder}/{name}" for name in names}

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Add rows, whatever keys the table has; returns a scan of what was added."""
        held, added = self.state.buckets.setdefault(table, {}), self.added.setdefault(table, {})
        written = self._written(table, rows)
        new = State(self.version, {table: {bucket: [part] for bucket, part in written.items()}})
        for bucket, part in written.items():
            held.setdefault(bucket, []).append(part)
            if bucket in self.anew.get(table, {}):
                self.anew[table][bucket] = held[bucket]
            else:
                added.setdefault(bucket, []).append(part)
        return self.store._scan_state(table, new)

    def put(self, table: str, rows: DataFrame, buckets: set[int]) -> None:
        """``rows`` are all there is in ``buckets`` from now on."""
        held, anew = self.state.buckets.setdefault(table, {}), self.anew.setdefault(table, {})
        parts = self._written(table, rows) if buckets else {}
        for bucket in buckets:
            held[bucket] = [parts[bucket]] if bucket in parts else []
            anew[bucket] = held[bucket]
            self.added.get(table, {}).pop(bucket, None)

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace the whole table."""
        self.put(table, rows, set(range(self.store.tables[table].buckets)))

    def replace(self, table: str, rows: DataFrame, keys: DataFrame | None = None, settled: bool = False) -> None:
        """``rows`` in place of all rows with one of ``keys``, by default the keys of ``rows``; ``settled`` if they lie in files."""
        key = list(self.store.tables[table].key)
        if not any(self.state.buckets.get(table, {}).values()):
            self.append(table, rows)  # nothing is there yet
            return
        with passing(self.store.spark):
            rows = rows if settled else settle(rows, "replacing")
            if keys is None:
                keys = rows.select(*key)
            else:
                keys = settle(keys.select(*key).unionByName(rows.select(*key)).distinct(), "replaced-keys")
            buckets = self.store.buckets_of(table, keys)
            stay = lookup_join(self.scan(table, buckets), keys, key, "left_anti")
            self.put(table, stay.select(*rows.columns).unionByName(rows), buckets)

    def delete(self, table: str, other: DataFrame, on: Sequence[str]) -> None:
        """Drop the rows that have a partner in ``other``; buckets without such a row stay as they are."""
        spec, on = self.store.tables[table], list(on)
        with passing(self.store.spark):
            keys = settle(other.select(*on).distinct(), "deleted-keys")
            may = self.store.buckets_of(table, keys) if set(on) == set(spec.key) else None
            held = self.scan(table, may)
            hit = {row[0] for row in lookup_join(held, keys, on, "left_semi").select(spec.bucket()).distinct().collect()}
            left = lookup_join(self.scan(table, hit), keys, on, "left_anti")
            self.put(table, left.select(*spec.schema.names), hit)

    def merge(self, table: str, most: int = 8) -> None:
        """Put together the parts of every bucket that has more than ``most``."""
        many = {b for b, parts in self.state.buckets.get(table, {}).items() if len(parts) > most}
        if many:
            self.put(table, self.scan(table, many), many)

    def publish(self) -> int:
        """Make the change visible as a whole."""
        self.store.log.publish(self.version, State(self.version, self.state.buckets), self.added, self.anew)
        return self.version
