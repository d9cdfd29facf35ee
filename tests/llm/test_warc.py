from __future__ import annotations

import base64
import hashlib
import re

import pytest
from pyspark.errors import PySparkException

from marquee.llm import warc

PAYLOADS = [
    "<p>one</p>", "<p>one</p>", "", None, "line\r\n\r\nline\r\n", "é 日本 🙂", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx",
    "a WARC/1.1\r\nb WARC/1.1\r\nc", "ends with WARC/1.1", "WARC/1.1", "0\r\n\r\n", "x" * 200_000, "x" * 200_000, "\x00\x01", "\r\n\r\n",
]


def rows():
    out = [(i, f"http://h{i}.example/p?{i}", html) for i, html in enumerate(PAYLOADS)]
    out += [(100, None, "<p>one</p>"), (101, "bad url\r\nX-Page-Id: 7", "odd url"), (None, "http://no.id/", "<p>one</p>"), (None, "http://no.id/2", "no id")]
    return out + [out[4], (-5, "http://late.example/", PAYLOADS[5])]


def want(data, least):
    first = {}
    for page, _, html in data:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in data:
        raw = (html or "").encode()
        original = first.get(html or "")
        revisit = original is not None and original != page
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_written_and_read_back(spark, tmp_path, least):
    data = rows()
    pages = spark.createDataFrame([(*r, "extra", 1) for r in data], "page_id long, url string, html string, digest string, original int").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=least)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, warc.resolve(records).collect()), key=str) == want(data, least)
    texts = {r.page_id: r.payload for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert all(texts[page] == (html or "") for page, _, html in data if page in texts)


def test_records_are_well_formed(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    data, seen = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*"))), 0
    while data:  # by the lengths alone, as any reader of the format does
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        assert (fields[b"WARC-Type"] == b"revisit") == (n == 0) == (b"WARC-Refers-To" in fields)
        data, seen = rest[n + 4 :], seen + 1
    assert seen == len(rows())


def written(spark, path, rows) -> bytes:
    """The bytes of all archives; Spark may write empty ones beside those with records."""
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(path))
    return b"".join(part.read_bytes() for part in sorted(path.glob("part-*")))


def damaged(path, name, data: bytes) -> str:
    (path / name).mkdir()
    (path / name / "x.warc").write_bytes(data)
    return str(path / name)


ALTERED = {
    "payload": (b"abc", b"abd"),
    "payload_without_digest": (rb"WARC-Payload-Digest: [^\r]*\r\n", b""),
    "empty_digest": (rb"WARC-Payload-Digest: sha1:[^\r]*", b"WARC-Payload-Digest: sha1:"),
    "no_length": (rb"(msgtype=response)\r\nContent-Length: [1-9]\d+", rb"\1"),
    "odd_length": (rb"(msgtype=response\r\nContent-Length: )[1-9]\d+", rb"\1many"),
    "no_type": (rb"WARC-Type: response\r\n", b""),
    "revisit_length": (rb"Content-Length: 0", b"Content-Length: 3"),
    "revisit_without_length": (rb"Content-Length: 0\r\n", b""),
    "revisit_without_digest": (rb"(WARC-Type: revisit(?:\r\n[^\r]+)*?)\r\nWARC-Payload-Digest: [^\r]*", rb"\1"),
}


@pytest.fixture(scope="module")
def sound(spark, tmp_path_factory) -> bytes:
    path = tmp_path_factory.mktemp("sound")
    data = written(spark, path / "w", [(1, "u", "abc"), (2, "v", "abc")])
    assert warc.read_archives(spark, damaged(path, "same", data)).count() == 2
    return data


@pytest.mark.parametrize("name", sorted(ALTERED))
def test_damage_is_noticed(spark, tmp_path, sound, name):
    """Also by a reader of one column, and by ``resolve``, which drops most of a record."""
    altered = re.sub(*ALTERED[name], sound)
    assert altered != sound
    records = warc.read_archives(spark, damaged(tmp_path, "d", altered))
    for read in (lambda: records.select("uri"), lambda: warc.resolve(records)):
        with pytest.raises(PySparkException):
            read().collect()


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0
