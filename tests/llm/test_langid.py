from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from marquee.llm import langid

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int, found string"


def test_forward_backward_equals_all_paths():
    rnd = np.random.default_rng(0)
    scores, moves = rnd.normal(size=(3, 5, 3)), rnd.normal(size=(3, 3))
    used = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    found, expected = langid.marginals(scores, used, moves)
    total = np.zeros((3, 3))
    for chain in range(3):
        n = int(used[chain].sum())
        paths = list(itertools.product(range(3), repeat=n))
        weight = np.array([np.exp(sum(scores[chain, t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            want = [weight[[p[t] == k for p in paths]].sum() for k in range(3)]
            assert found[chain, t] == pytest.approx(want)
        for p, w in zip(paths, weight, strict=True):
            for t in range(n - 1):
                total[p[t], p[t + 1]] += w
    assert expected == pytest.approx(total)


WORDS = {"en": "the of and thon erin with that", "fr": "le la et ellé queaux où éan", "de": "der und ßich ver ungen zu auf"}


def corpus(n=160):
    rnd = random.Random(1)
    return [(i, " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(["", "s", "er"]) for _ in range(rnd.randint(3, 300))), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


ODD = [(900, None, "en"), (901, "", "fr"), (902, "123 -- ?!", "de"), (903, "¿¡…", None), (None, "the of and", "en"), (904, "the " * 300_000, None), (905, "日本語", None), (906, "the of", "xx")]


@pytest.fixture(scope="module")
def field(spark):
    return langid.learn(spark.createDataFrame([(*r, 1, "f") for r in corpus()], SCHEMA))


def test_labels_and_odd_texts(spark, field):
    docs = spark.createDataFrame([(*r, 1, "f") for r in corpus() + ODD + corpus()[:2]], SCHEMA).repartition(4)
    out = langid.label(docs, field)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and set(docs.columns) <= set(out.columns)
    assert all(rows[i].lang_pred == lang for i, _, lang in corpus())
    assert {rows[i].lang_pred for i in (900, 901, 902, 903)} == {"und"} and rows[900].score == 0
    assert rows[None].lang_pred == rows[904].lang_pred == "en" and rows[905].lang_pred in WORDS
    assert all(0 <= r.score <= 1 and r.found == "f" for r in rows.values())
    kept = langid.keep_known(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {r[0] for r in corpus()} | {904}
    assert not {900, 901, 902, 903} & {r.doc_id for r in kept.collect()}


def test_code_switched_words(spark, field):
    text = "the of and thon erin with that the of and " * 2 + "le la et ellé queaux où éan le la et " * 2
    runs = langid.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), field)
    rows = {r.doc_id: [(x.lang, x.words) for x in r.runs] for r in runs.collect()}
    assert rows == {1: [("en", 20), ("fr", 20)], 2: []}


def test_clean_texts_of_several_languages_stay(spark, field):
    en, fr, de = (words.split() * 20 for words in WORDS.values())
    mixed = [(1, " ".join(en[:40] + fr[:35] + de[:25])), (2, " ".join(en[:50] + fr[:50])), (3, " ".join(de[:34] + en[:33] + fr[:33]))]
    docs = spark.createDataFrame([*mixed, (4, "123"), (5, None)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in langid.label(docs, field).collect()}
    assert scores[1] < 0.5 and scores[3] < 0.5
    assert {r.doc_id for r in langid.keep_known(docs, field).collect()} == {1, 2, 3}


def test_uncertain_words_go(spark, field):
    vague = langid.Field(field.labels, np.zeros_like(field.weights), np.zeros_like(field.moves))  # each word a third
    docs = spark.createDataFrame([(1, "the of and"), (2, "le la et")], "doc_id long, text string")
    assert langid.keep_known(docs, vague).count() == 0 and langid.keep_known(docs, vague, 0.3).count() == 2


def test_only_what_is_not_held_out_is_learned(spark):
    docs = spark.createDataFrame([(*r, 1, "f") for r in corpus()], SCHEMA)
    asked = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out(docs.doc_id).alias("h")).collect()}
    import zlib

    assert asked == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in asked}
    hidden = docs.where(langid.held_out(docs.doc_id))
    assert langid.learn(hidden) is None and langid.learn(docs.limit(0)) is None
    rows = langid.label(docs, None).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in rows] == [("und", 0.0)]


def test_a_long_text_in_parts_is_read_whole(field):
    import pyarrow as pa

    text = "the of and " * 200_000 + "le la et " * 350_000
    names, score = langid._predicted(field, pa.array(["x", text, None, "der und zu"]).slice(1))
    assert names == ["fr", "und", "de"] and 0.6 < score[0] < 0.68


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")
def test_held_out_accuracy(spark):
    from marquee.llm.queries import op10_language

    found = op10_language(spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count() > 0
