from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from marquee.sources.buckets import BUCKET, BucketStore, Keyed
from marquee.sources.log import folder_names

SCHEMA = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.StringType()), T.StructField("n", T.IntegerType())])
OTHER = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("x", T.DoubleType())])


def store(spark, tmp_path, buckets=8, era=32):
    return BucketStore(spark, str(tmp_path / "store"), {"t": Keyed(SCHEMA, ("k",), buckets), "other": Keyed(OTHER, ("name",), 1)}, era)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, n int")


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_equal_a_dictionary(spark, tmp_path):
    """Random replaces, appends, deletes and merges, in eras of three versions, against plain rows."""
    rnd, kept, plain = random.Random(4), store(spark, tmp_path, 5, era=3), []
    assert kept.latest() is None and content(kept.read("t")) == []
    history = []
    for version in range(8):
        change = kept.change()
        assert change.version == version
        for _ in range(2):
            rows = [(rnd.randrange(30), rnd.choice("ab"), version) for _ in range(rnd.choice([0, 1, 6]))]
            what = rnd.choice(["replace", "append", "delete", "delete_by", "replace_keys", "merge"])
            if what == "replace":
                change.replace("t", frame(spark, rows))
                plain = [r for r in plain if r[0] not in {k for k, _, _ in rows}] + rows
            elif what == "append":
                change.append("t", frame(spark, rows))
                plain = plain + rows
            elif what == "delete":
                change.delete("t", frame(spark, rows), ["k"])
                plain = [r for r in plain if r[0] not in {k for k, _, _ in rows}]
            elif what == "delete_by":
                change.delete("t", frame(spark, rows), ["k", "v"])
                plain = [r for r in plain if r[:2] not in {(k, v) for k, v, _ in rows}]
            elif what == "replace_keys":
                keys = [(rnd.randrange(30), None, None) for _ in range(3)]
                change.replace("t", frame(spark, rows), frame(spark, keys))
                plain = [r for r in plain if r[0] not in {k for k, _, _ in rows + keys}] + rows
            else:
                change.merge("t", 1)
            assert content(change.read("t")) == sorted(plain, key=str), what
        assert kept.latest() == (version - 1 if version else None)  # not seen before it is published
        assert change.publish() == version
        history.append(sorted(plain, key=str))
    for version, rows in enumerate(history):
        assert content(kept.read("t", version=version)) == rows
    some = frame(spark, [(k, None, None) for k in (1, 2, 3, 99)])
    assert content(kept.read("t", some)) == [r for r in history[-1] if r[0] in (1, 2, 3)]
    kept.keep_last(2)
    assert [content(kept.read("t", version=v)) for v in (6, 7)] == history[6:]
    assert kept.log._eras() == [2]


def test_a_small_change_rewrites_few_files(spark, tmp_path):
    """One customer in a hundred changes: about one file in a hundred does."""
    kept = store(spark, tmp_path, buckets=200)
    change = kept.change()
    change.write("t", spark.range(1000).selectExpr("id k", "'old' v", "1 n"))
    change.publish()
    files = set(kept.files("t"))
    reader = kept.read("t")
    one = frame(spark, [(5, "new", 2), (600, "new", 2)])
    change = kept.change()
    change.replace("t", one)
    change.publish()
    after = set(kept.files("t"))
    assert len(files) > 190 and len(after - files) == len(files - after) == 2
    change = kept.change()
    change.delete("t", frame(spark, [(7, "old", 0)]), ["k"])
    change.publish()
    assert len(set(kept.files("t")) ^ after) in (1, 2)
    assert reader.where("v = 'new'").count() == 0 and reader.count() == 1000  # of the version it has found
    assert kept.read("t").where("v = 'new'").count() == 2 and kept.read("t").count() == 999
    assert len(kept.read("t", one).inputFiles()) == 2


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        change = store(spark, tmp_path).change()
        change.append("t", spark.range(60_000).selectExpr("1 k", "uuid() v", "1 n").repartition(16))
        assert len(change.read("t").inputFiles()) > 4 and change.read("t").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def test_tables_change_together_and_a_repeat_is_another_attempt(spark, tmp_path):
    kept = store(spark, tmp_path)
    for value in ("first", "second"):
        change = kept.change(version=0)
        change.write("t", frame(spark, [(1, value, 0)]))
        change.write("other", spark.createDataFrame([(value, 1.0)], OTHER))
        change.publish()
    assert content(kept.read("t")) == [(1, "second", 0)] and content(kept.read("other")) == [("second", 1.0)]
    change = kept.change()
    change.replace("t", frame(spark, [(1, "unfinished", 0)]))  # never published
    later = kept.change()
    assert later.version == 1 and content(later.read("t")) == [(1, "second", 0)]
    later.publish()
    assert kept.latest() == 1 and content(kept.read("t")) == [(1, "second", 0)]
    kept.keep_last(1)
    folders = folder_names(spark, f"{kept.path}/data/t")
    assert len(folders) == 1 and all(n.startswith(BUCKET) or n.startswith("_") for n in folder_names(spark, f"{kept.path}/data/t/{folders[0]}"))
    with pytest.raises(FileNotFoundError):
        kept.read("t", version=9)


def test_rows_must_fit_the_declared_table(spark, tmp_path):
    change = store(spark, tmp_path).change()
    with pytest.raises(PySparkException):
        change.append("t", frame(spark, [(None, "x", 1)]))
    with pytest.raises(ValueError):
        change.append("t", spark.range(1))
