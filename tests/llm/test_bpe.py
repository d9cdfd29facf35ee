from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from marquee.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  x", "naïve café 日本語 🙂", "x" * 5000, "a'll've 123 --", "\x00\x7f", "é", " " * 300]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(ranks, n, seed):
    rnd, tokens = random.Random(seed), list(ranks)
    for _ in range(n):
        if rnd.random() < 0.5:
            yield "".join(rnd.choice("abcdetionshTHE 'é日🙂0123\n\t.,-_=*") for _ in range(rnd.randint(0, 80)))
        else:
            yield b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 9))).decode("utf-8", "replace")


@pytest.mark.parametrize("states", [200, 1 << 20])
def test_transducer_equals_the_library(ranks, library, monkeypatch, states):
    """Also when its tables are forgotten all the time."""
    monkeypatch.setattr(bpe, "MAX_STATES", states)
    monkeypatch.setattr(bpe, "MAX_PIECES", states)
    monkeypatch.setattr(bpe, "MAX_HEADS", states)
    pieces, cut = bpe.Pieces(bpe.Transducer(ranks)), regex.compile(public_tokenizers.PATTERN)
    for text in random_texts(ranks, 2000, states):
        assert np.frombuffer(bpe.encode_text(text, pieces, cut), np.int32).tolist() == library.encode_ordinary(text)


def test_long_texts_are_cut_up(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    pieces, cut = bpe.Pieces(bpe.Transducer(ranks)), regex.compile(public_tokenizers.PATTERN)
    text = " ".join(random_texts(ranks, 300, 4))
    assert np.frombuffer(bpe.encode_text(text, pieces, cut), np.int32).tolist() == library.encode_ordinary(text)


def test_decoding_in_blocks(ranks, library, monkeypatch):
    table, text = bpe.TokenTable(ranks), "".join(t or "" for t in ODD) * 3
    ids = np.array(library.encode_ordinary(text), np.int32)
    for block in (1, 2, 3, 1000):
        monkeypatch.setattr(bpe, "DECODE_IDS", block)
        assert bpe.decode_ids(ids, table) == text
    alone = np.array([ranks[b"\xe6"]], np.int32)
    assert bpe.decode_ids(alone, table) == "�"
    for wrong in (-1, 50256, 1 << 30):
        with pytest.raises(ValueError):
            bpe.decode_ids(np.array([wrong], np.int32), table)


def test_columns(spark, library):
    texts = ODD + ["same text"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    encode, decode = bpe.encoder(spark, PATH, public_tokenizers.PATTERN), bpe.decoder(spark, PATH)
    both = bpe.round_trip(spark, PATH, public_tokenizers.PATTERN)
    rows = docs.select("doc_id", encode("text").alias("ids"), both("text").alias("both")).withColumn("back", decode("ids")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert row.ids == row.both.ids == library.encode_ordinary(text)
        assert row.back == row.both.text == text
    assert docs.limit(0).select(both("text")).count() == 0


def test_null_ids(spark):
    rows = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in rows.select(bpe.decoder(spark, PATH)("ids")).collect()] == ["", ""]


def test_chunked_offsets(ranks):
    batch = pa.array(["drop", "a b", None, "c"]).slice(1)
    ids = bpe._encoded(batch, bpe.Pieces(bpe.Transducer(ranks)), regex.compile(public_tokenizers.PATTERN))
    assert bpe._decoded(ids, bpe.TokenTable(ranks)).to_pylist() == ["a b", "", "c"]
