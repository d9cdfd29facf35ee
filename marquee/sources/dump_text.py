"""Tab-delimited table dumps: ``\\N`` is null, ``\\.`` ends the data, backslash escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.sources.catalog import TABLES, Table

# Escape letter -> character.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _unescaped(field: Column) -> Column:
    # Doubled backslashes are taken out first, so what is left in each piece is
    # a backslash that escapes the character behind it.
    def plain(piece: Column) -> Column:
        for letter, character in ESCAPES.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(character))
        return F.regexp_replace(piece, r"\\(.)", "$1")

    simple = F.array_join(F.transform(F.split(field, r"\\\\", -1), plain), "\\")
    return F.when(field == "\\N", None).when(F.contains(field, F.lit("\\")), simple).otherwise(field)


def _array(field: Column) -> Column:
    """``{a,"b, c",NULL}`` as an array of strings."""
    items = F.regexp_extract_all(field, F.lit(r'("(?:[^"\\]|\\.)*"|[^,{}]+)'), F.lit(1))

    def item(text: Column) -> Column:
        inner = F.regexp_replace(text.substr(F.lit(2), F.length(text) - 2), r"\\(.)", "$1")
        return F.when(F.startswith(text, F.lit('"')), inner).when(text != "NULL", text)

    return F.transform(items, item)


def _tokens(field: Column) -> Column:
    """Lexemes of ``'word':1,3 'other':2``, positions dropped."""
    found = F.regexp_extract_all(field, F.lit(r"'((?:[^']|'')*)'"), F.lit(1))
    return F.transform(found, lambda word: F.replace(word, F.lit("''"), F.lit("'")))


def _typed(field: Column, kind: str, target: T.DataType, padded: bool) -> Column:
    if kind == "texts":
        return _array(field)
    if kind == "tokens":
        return _tokens(field)
    if kind == "bytes":
        return F.unhex(F.regexp_replace(field, r"^\\x", ""))
    if padded:
        return F.rtrim(field)
    return field.cast(target)


def read_copy_text(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A dump file as a DataFrame with the table's schema.

    A line with another number of fields than the table has columns is an error.
    """
    width = len(table.columns)
    lines = spark.read.option("lineSep", "\n").text(path)
    no_row = F.col("value") == "\\."
    if width > 1:
        no_row = no_row | (F.col("value") == "")
    # Spark may evaluate the columns before the filter: lines that hold no row give nulls.
    fields = F.when(~no_row, F.split("value", "\t", -1))
    checked = lines.where(~no_row).select(
        F.when(no_row | (F.size(fields) == width), fields)
        .otherwise(F.raise_error(F.concat(F.lit(f"expected {width} fields: "), F.col("value"))))
        .alias("fields")
    )
    return checked.select(
        *[
            _typed(
                _unescaped(F.get("fields", F.lit(i))), c.kind, table.schema[i].dataType, c.padded
            ).alias(c.name)
            for i, c in enumerate(table.columns)
        ]
    )


def read_copy_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dump file of one of the shop's tables."""
    return read_copy_text(spark, path, TABLES[name])


def _quoted(item: Column) -> Column:
    """An item of an array: in quotes, or NULL."""
    inner = F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), inner, F.lit('"')), F.lit("NULL"))


def _as_text(name: str, kind: T.DataType, lexemes: bool) -> Column:
    """A field as a dump shows it, before escaping; the inverse of ``_typed``."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        if lexemes:
            words = F.transform(value, lambda word: F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("''")), F.lit("'")))
            return F.array_join(words, " ")
        return F.concat(F.lit("{"), F.array_join(F.transform(value, _quoted), ","), F.lit("}"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"{name}: a dump cannot hold {kind.simpleString()}")
    return value.cast("string")


def copy_lines(df: DataFrame, table: Table | None = None) -> DataFrame:
    """Rows as dump lines (one ``value`` column), the inverse of reading them.

    ``table`` is needed where an array holds lexemes. Nested types raise.
    """
    lexemes = {c.name for c in table.columns if c.kind == "tokens"} if table else set()

    def escaped(field: T.StructField) -> Column:
        text = F.replace(_as_text(field.name, field.dataType, field.name in lexemes), F.lit("\\"), F.lit("\\\\"))
        for letter, character in ESCAPES.items():
            text = F.replace(text, F.lit(character), F.lit("\\" + letter))
        return F.coalesce(text, F.lit("\\N"))

    return df.select(F.concat_ws("\t", *[escaped(field) for field in df.schema.fields]).alias("value"))
