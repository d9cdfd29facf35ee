"""Cut a plan by writing it to the shared scratch folder and reading it back.

A settled table survives lost executors, is read as often as needed without
recomputing its inputs, and keeps column pruning and size statistics.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES = threading.local()  # paths settled in the scopes that are open


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse.

    A warehouse on local disks is no shared folder: that is refused unless everything runs on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not local and warehouse.split(":/")[0] in ("file", warehouse):
        raise RuntimeError(f"executors do not share {warehouse}: set spark.checkpoint.dir to a folder they all reach")
    return f"{warehouse}/scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, grouped by application."""
    app = spark.sparkContext.applicationId
    return f"{scratch_dir(spark)}/marquee-{app}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    Inside ``passing`` the table goes when the scope ends; with ``keep`` it belongs to what is around the scope.
    """
    path = scratch_path(df.sparkSession, label)
    scopes = getattr(_SCOPES, "open", [])
    if scopes[: len(scopes) - keep]:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables settled within are deleted at the end: what was made of them must be written by then, and kept."""
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on whatever file system ``path`` names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_settled(spark: SparkSession) -> None:
    """Delete what this application settled; DataFrames built on it end here."""
    delete_path(spark, f"{scratch_dir(spark)}/marquee-{spark.sparkContext.applicationId}")
