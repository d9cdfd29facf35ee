from __future__ import annotations

import os

import public_tokenizers
import pytest
import tiktoken

import check
import corpus_pipeline
from marquee.llm import bpe, langid
from marquee.llm.oracle import ORACLE
from marquee.llm.queries import QUERIES
from tests.llm.brute import near_copies
from tests.llm.test_lines import brute as brute_lines

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    assert name in QUERIES and check.compare(spark, connection, FOLDER, name) is None


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9003, "123", "en", "src0", 3)], docs.schema)
    docs, columns = docs.union(odd), docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        results[name] = (before, docs)
        assert name == "encode" or docs.columns == columns

    before, after = results["language"]
    kept = {r.doc_id for r in langid.label(before, langid.learn(before)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in after.collect()} == kept and not kept & {9001, 9002, 9003}
    assert len(kept) >= 0.98 * (before.count() - 3)

    before, after = results["line_dedup"]
    want = {r[0]: r[1] for r in brute_lines([(r.doc_id, r.text, r.source) for r in before.collect()], 0.1, 2)}
    assert {r.doc_id: r.text for r in after.collect()} == want

    before, after = results["near_copies"]
    groups = near_copies([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
    assert sorted(r.doc_id for r in after.collect()) == sorted({k for k, (_, least) in groups.items() if k == least})

    before, after = results["mix_sources"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect()) and after.count() > before.count()

    before, after = results["encode"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = after.collect()
    assert len(rows) == before.count() and all(r.round_trip for r in rows)
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_run_is_repeatable(spark):
    runs = [sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, FOLDER).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) > 0
