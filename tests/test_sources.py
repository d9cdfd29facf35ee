from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from marquee.functions.text import rating_rank
from marquee.operators import quality
from marquee.operators.settle import scratch_dir, settle
from marquee.sources.catalog import DEFAULTS, FOREIGN_KEYS, TABLES, define_table
from marquee.sources.dump_text import copy_lines, read_copy_table, read_copy_text
from marquee.sources.load import load_shop, with_table_defaults
from marquee.sources.shop import Shop
from marquee.sources.versions import VersionedTable, fit_schema

STAMP = "2006-02-15 09:46:27"
# Hand-written dump files, one per layout.
DUMPS = {
    "actor": "1\tAnn\tLee\t2013-05-26 14:47:57.62\n2\tBob\tRay\t2013-05-26 14:47:57.62\n\\.\n\n\n",
    "category": f"1\tAction\t{STAMP}\n\\.\n\n\n",
    "film_category": f"1\t1\t{STAMP}\n2\t1\t{STAMP}\n\\.\n\n\n",
    "city": f"1\tA Corua (La Corua)\t1\t{STAMP}\n\\.\n\n\n",
    "country": f"1\tSpain\t{STAMP}\n\\.\n\n\n",
    "language": f"1\tEnglish             \t{STAMP}\n\\.\n\n\n",
    "staff": f"1\tMia\tHay\t1\tm@x.org\t1\tt\tMia\tabc\t{STAMP}\t\\\\x89504e47\n2\tJo\tSun\t1\t\\N\t1\tf\tJo\t\\N\t{STAMP}\t\\N\n\\.\n\n\n",
    "store": f"1\t1\t1\t{STAMP}\n\\.\n\n\n",
    "film": "1\tAcademy\tOld\\\\new\\tcase\\n2\t2006\t1\t6\t0.99\t86\t20.99\tPG-13\t"
    f"{STAMP}\t{{\"Deleted Scenes\",Trailers,\"a, \\\\\"b\\\\\"\",NULL}}\t'academi':1 'it''s':2,5\n\\.\n\n\n",
}


@pytest.fixture
def dump(tmp_path):
    paths = {}
    for name, text in DUMPS.items():
        (tmp_path / f"{name}.dat").write_text(text)
        paths[name] = str(tmp_path / f"{name}.dat")
    return paths


def test_dump_layouts(spark, dump):
    shop = Shop.from_dump(spark, dump)
    assert [tuple(r) for r in shop.actor.orderBy("actor_id").collect()][0] == (
        1, "Ann", "Lee", datetime(2013, 5, 26, 14, 47, 57, 620000),
    )
    assert {name: getattr(shop, name).count() for name in ("category", "film_category", "city", "country")} == {
        "category": 1, "film_category": 2, "city": 1, "country": 1,
    }
    assert shop.language.first()["name"] == "English"
    first, second = shop.staff.orderBy("staff_id").collect()
    assert (first.active, bytes(first.picture), second.active, second.picture, second.email) == (
        True, b"\x89PNG", False, None, None,
    )
    film = shop.film.first()
    assert film.description == "Old\\new\tcase\n2"
    assert film.rental_rate == Decimal("0.99") and film.release_year == 2006
    assert film.special_features == ["Deleted Scenes", "Trailers", 'a, "b"', None]
    assert film.fulltext == ["academi", "it's"]
    assert [f.dataType for f in shop.film.schema] == [f.dataType for f in TABLES["film"].schema]


def test_dump_line_with_wrong_width_is_an_error(spark, tmp_path):
    (tmp_path / "c.dat").write_text("1\tonly two\n")
    with pytest.raises(PySparkException):
        read_copy_table(spark, str(tmp_path / "c.dat"), "category").collect()


def test_dump_round_trip_of_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = ["", "\\", "\\N", "\\.", "a\tb", "x\\ny", "\n", "\r\n", "\\\\t", "\v\f\b", None, "é {\"q\"}"]
    texts += ["".join(rng.choice("\\tnN.\t\n\rab{}\"'") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    table = define_table("i", "i int!, t text")
    df = spark.createDataFrame(list(enumerate(texts)), table.schema)
    copy_lines(df).write.text(str(tmp_path / "t"))
    back = read_copy_text(spark, str(tmp_path / "t"), table).orderBy("i").collect()
    assert [r.t for r in back] == texts


def test_dump_round_trip_of_types(spark, tmp_path):
    table = define_table("i", "i int!, ok bool, raw bytes, many texts, words tokens, fee money")
    rows = [
        (1, True, b"\x89PNG\\\n", ["x", 'b "q"', "c\\d, {e}", None, "NULL", ""], ["it's", "a"], Decimal("1.50")),
        (2, False, b"", [], ["z"], Decimal("-0.05")),
        (3, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, table.schema)
    copy_lines(df, table).write.text(str(tmp_path / "t"))
    back = read_copy_text(spark, str(tmp_path / "t"), table).orderBy("i").collect()
    assert [tuple(r) for r in back] == [(r[0], r[1], None if r[2] is None else bytearray(r[2]), *r[3:]) for r in rows]
    with pytest.raises(TypeError):
        copy_lines(spark.range(1).selectExpr("struct(id) s"))


def test_every_table_with_an_update_time_has_its_default():
    have = {name for name, table in TABLES.items() if "last_update" in [c.name for c in table.columns]}
    assert len(have) == 14 and all(DEFAULTS[name]["last_update"] == "now" for name in have)


def test_versions_publish_and_retry(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.latest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.write(spark.range(3)) == 0
    assert table.append(spark.range(10, 12)) == 1
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 10, 11]
    # data of an unfinished version is not read, and writing it again replaces it
    spark.range(99).write.parquet(str(tmp_path / "t/data/2-unfinished"))
    assert table.read().count() == 5
    assert table.delete_using(spark.range(2), ["id"]) == 2
    assert sorted(r.id for r in table.read().collect()) == [2, 10, 11]
    # a reader keeps the files it found while a published version is written again
    reader = table.read()
    assert table.write(spark.range(1), version=2) == 2 and table.read().count() == 1
    assert sorted(r.id for r in reader.collect()) == [2, 10, 11]
    table.keep_last(2)
    assert table.read().count() == 1 and table.read(1).count() == 5
    assert table.write(spark.range(4)) == 3
    table.keep_last(1)
    assert table.read().count() == 4
    left = {p.name.split("-")[0] for p in (tmp_path / "t/data").iterdir() if p.name != "2-unfinished"}
    assert left == {"3"}


def test_append_adds_files_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3).selectExpr("id", "cast(id as string) s"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    table.append(spark.range(3, 5).selectExpr("cast(id as string) s", "id"))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    assert before.items() <= after.items() and table.read(0).count() == 3
    assert sorted((r.id, r.s) for r in table.read().collect()) == [(i, str(i)) for i in range(5)]
    with pytest.raises(ValueError):
        table.append(spark.range(1))


def test_schema_is_enforced(spark):
    schema = T.StructType([T.StructField("a", T.DecimalType(5, 2), False), T.StructField("b", T.StringType())])
    good = spark.createDataFrame([("x", 1.239)], "b string, a double")
    assert fit_schema(good, schema).collect()[0].asDict() == {"a": Decimal("1.24"), "b": "x"}
    for bad in ([("x", None)], [("x", 12345.0)]):
        with pytest.raises(PySparkException):
            fit_schema(spark.createDataFrame(bad, "b string, a double"), schema).collect()
    with pytest.raises(ValueError):
        fit_schema(good.withColumnRenamed("b", "c"), schema)


def test_settled_tables_live_in_the_shared_folder(spark):
    settled = settle(spark.range(5).selectExpr("id", "cast(null as string) as s"), "test")
    assert settled.schema.names == ["id", "s"] and settled.count() == 5
    assert all(scratch_dir(spark) in path for path in settled.inputFiles())
    assert settle(spark.range(0), "empty").count() == 0


def test_loaded_tables_and_defaults(spark, dump, tmp_path):
    shop = load_shop(spark, dump, str(tmp_path / "shop"))
    assert shop.staff.count() == 2 and shop.film.first().special_features[1] == "Trailers"
    with pytest.raises(ValueError):
        load_shop(spark, {"nothing": "x"}, str(tmp_path / "shop"))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None, None, None), (2, 7, Decimal("1.50"), "R")], "film_id int, rental_duration int, rental_rate decimal(4,2), rating string")
    df = df.withColumn("replacement_cost", F.lit(None).cast("decimal(5,2)"))
    out = with_table_defaults(df, "film", F.current_timestamp()).orderBy("film_id").collect()
    assert tuple(out[0]) == (1, 3, Decimal("4.99"), "G", Decimal("19.99"))
    assert tuple(out[1]) == (2, 7, Decimal("1.50"), "R", Decimal("19.99"))
    assert with_table_defaults(df, "city", F.current_timestamp()) is df


def test_ratings_have_their_own_order(spark):
    df = spark.createDataFrame([("R",), ("G",), ("NC-17",), ("PG-13",), ("PG",), ("X",), (None,)], "r string")
    ranked = {row.r: row.n for row in df.select("r", rating_rank("r").alias("n")).collect()}
    assert ranked == {"G": 1, "PG": 2, "PG-13": 3, "R": 4, "NC-17": 5, "X": None, None: None}


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "a", 5, 1.0), (1, "bb", 50, 99.994), (2, None, None, 99.996), (None, "a", 7, -100.0)],
        "k int, s string, n int, x double",
    )
    out = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert out(quality.check_primary_key(df, ["k"])) == [(1, 2), (None, 1)]
    assert out(quality.check_unique(df, ["s"])) == [("a", 2)]
    parent = spark.createDataFrame([(1,)], "k int")
    assert out(quality.check_foreign_key(df, "k", parent, "k")) == [(2, 1)]
    assert out(quality.check_not_null(df, ["k", "s", "x"])) == [("k", 1), ("s", 1)]
    assert [r.n for r in quality.check_range(df, "n", 1, 10).collect()] == [50]
    assert [r.s for r in quality.check_allowed(df, "s", ["a"]).collect()] == ["bb"]
    assert [r.s for r in quality.check_length(df, {"s": 1}).collect()] == ["bb"]
    assert sorted(r.x for r in quality.check_precision(df, "x", 4, 2).collect()) == [-100.0, 99.996]


def test_declared_rules_of_a_shop(spark, dump):
    assert len(TABLES) == 15 and len(FOREIGN_KEYS) == 18
    shop = Shop.from_dump(spark, dump)
    tables = ["actor", "city", "country", "film_category", "category", "film"]
    found = {(r.table_name, r.rule, r.columns): r.violations for r in quality.check_shop(shop, tables).collect()}
    # film 2 is not in the film file; everything else holds
    assert {k: v for k, v in found.items() if v} == {("film_category", "foreign key", "film_id"): 1}
    assert found[("film_category", "primary key", "film_id, category_id")] == 0
