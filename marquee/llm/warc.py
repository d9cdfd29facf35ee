"""WARC archives in which repeated payloads are revisit records.

Payloads are digested where they lie; only headers (digest, id) are shuffled. Of equal payloads the smallest id is the
response, the others refer to it. The table of repeated digests is written before it meets the payloads, so Spark
knows its size; when it is small, payloads are not shuffled at all.

Archives are written and read as text by Spark itself, on any file system: a record is one row, ended by the blank
lines that end a WARC record. Reading cuts at the version line, which can be done from any byte offset, so archives
are read in splits whatever their length. So that no payload can hold the version line, such a payload is sent in
chunks (HTTP/1.1 chunked coding) cut inside it.

Defined results: a null payload is empty; payloads shorter than ``min_bytes`` are all responses; rows that share the
smallest id of a payload are all responses; rows without an id revisit the smallest id, and are responses if none has
one; a null url is written as ``urn:page:<id>``; control characters and spaces in a url are
written as ``%20``. A record's id is made of page id and payload, so rows equal in both share one; an archive whose records
need ids of their own must hold a page once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import packed
from marquee.operators.settle import settle

# Fixed values of the formats.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32: eight digits for every ten of the hexadecimal form."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _uuid(*parts: Column) -> Column:
    digits = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return _uuid(F.coalesce(page_id.cast("string"), F.lit("")), digest)


def _chunked(payload: Column) -> Column:
    pieces = F.split(payload, r"(?<=WARC/1)(?=\.1(\r\n|\z))", -1)
    sized = F.transform(pieces, lambda p: F.concat(F.hex(F.octet_length(p)), F.lit("\r\n"), p, F.lit("\r\n")))
    return F.concat(F.array_join(sized, ""), F.lit("0\r\n\r\n"))


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per payload ``digest`` held by several pages the ``original``, the smallest id. Moves headers only."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = pages.select("page_id", payload_digest(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    return (
        headers.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("held"), F.min("page_id").alias("original"))
        .where((F.col("held") > 1) & F.col("original").isNotNull())
        .select("digest", "original")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives into the folder ``path``."""
    known = settle(roles(pages, min_bytes), "warc-originals").withColumnRenamed("digest", "of")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = packed(pages, page_id=F.col("page_id"), url=F.col("url"), payload=payload)
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).drop("row")
    rows = rows.join(known, F.col("digest") == F.col("of"), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))

    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), page)), r"[\x00-\x20\x7F]", "%20")
    split = F.concat(F.col("payload"), F.lit("\r\n")).contains(VERSION)
    body = F.when(split, _chunked(F.col("payload"))).otherwise(F.col("payload"))
    length = F.when(split, F.lit("Transfer-Encoding: chunked")).otherwise(
        F.concat(F.lit("Content-Length: "), F.octet_length("payload").cast("string"))
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), length, F.lit("\r\n\r\n"), body)
    block = F.when(revisit, F.lit("")).otherwise(http)
    fields = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-Id: "), page)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    head = F.concat(F.lit(VERSION), F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"))
    text = rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").text(path)


def _field(name: str) -> Column:
    """A header field of ``head``; null if it is absent."""
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _unchunked(body: Column) -> Column:
    """The pieces of a chunked body joined; sizes are octets, the cuts are where the writer made them."""
    whole = F.regexp_replace(body, r"(?s)\A[0-9A-F]+\r\n", "")
    whole = F.regexp_replace(whole, r"(?s)\r\n0\r\n\r\n\z", "")
    return F.regexp_replace(whole, r"(?<=WARC/1)\r\n[0-9A-F]+\r\n(?=\.1(\r\n|\z))", "")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``.

    Fails on a record without type, length or digest, and on one whose length or digest is not what its header says. The
    check is a filter that lets all rows pass, so it runs whichever columns a reader takes.
    """
    rows = spark.read.option("lineSep", VERSION).text(path).where(F.col("value") != "")
    gap = F.instr("value", "\r\n\r\n")
    rows = rows.select(
        F.substring("value", F.lit(1), gap - 1).alias("head"),
        F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4, length(value) - instr(value, '\\r\\n\\r\\n') - 7)").alias("block"),
    )
    rows = rows.select(
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("uri"),
        F.nullif(F.substring(_field("WARC-Payload-Digest"), len("sha1:") + 1, 32), F.lit("")).alias("payload_digest"),
        _field("WARC-Refers-To").alias("refers_to_record"),
        _field("X-Page-Id").cast("long").alias("page_id"),
        F.expr("try_cast(regexp_extract(head, '(?m)^Content-Length: ([^\\r\\n]*)', 1) as long)").alias("length"),
        "block",
    )
    start = F.instr("block", "\r\n\r\n")
    http = F.substring("block", F.lit(1), start - 1)
    body = F.expr("substring(block, instr(block, '\\r\\n\\r\\n') + 4)")
    body = F.when(http.contains("Transfer-Encoding: chunked"), _unchunked(body)).otherwise(body)
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", body))
    sound = (F.octet_length("block") == F.col("length")) & F.col("payload_digest").isNotNull() & (
        F.when(F.col("record_type") == "response", payload_digest(F.col("payload")) == F.col("payload_digest"))
        .otherwise(F.col("record_type").isNotNull())
    )
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("without id")))).cast("boolean")
    return rows.where(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(damaged)).drop("block", "length")


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``payload_bytes``, and for revisits ``refers_to``, the page id of the response.

    Revisits meet the responses by digest and record id; payloads stay where they are, headers are written once and move.
    """
    heads = records.select(
        "page_id", "record_type", "record_id", "refers_to_record", "payload_digest", F.octet_length("payload").cast("long").alias("bytes")
    )
    heads = settle(heads, "warc-headers")
    responses = heads.where(F.col("record_type") == "response").groupBy(
        F.col("payload_digest").alias("of"), F.col("record_id").alias("target")
    ).agg(F.min("page_id").alias("found"), F.min("bytes").alias("full"))
    same = (F.col("payload_digest") == F.col("of")) & (F.col("refers_to_record") == F.col("target"))
    return heads.join(responses, same, "left").select(
        "page_id",
        F.coalesce("bytes", "full").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("found").alias("refers_to"),
    )
