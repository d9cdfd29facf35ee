from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marquee.llm import importance
from marquee.llm.importance import Features

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def found(text, features):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, features.width + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) % features.buckets for run in runs]


def brute(rows, target, percent, min_words, seed, features):
    size = features.buckets
    s, t = (Counter(b for text in texts for b in found(text, features)[1]) for texts in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()) + size, sum(t.values()) + size
    out = []
    for doc_id, text in rows:
        words, own = found(text, features)
        gain = [math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in own]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, words, len(own), weight, score))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = len(able) * percent // 100
    ranked = [(*r, k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r, None) for r in out if r[1] < min_words]
    return sorted(ranked, key=str)


TEXTS = ["The cat, the CAT; a-b_c 42", "Éa É日本 z\x7fq", None, "", " \t\x00.,!", "one", "science of the atom and the cell " * 4, "noise " * 30]
ROWS = [(i, f"{TEXTS[i % 8]} word{i % 13}" if TEXTS[i % 8] else TEXTS[i % 8]) for i in range(160)]
ROWS += [(None, "no id " * 12), (None, "no id " * 12), (5, ROWS[6][1]), (6, ROWS[6][1]), (6, ROWS[6][1]), (900, "x" * 50_000 + " y")]
TARGET = ["Science of the cell", "the atom", None, ""]
SCHEMA = "doc_id long, text string"


def frames(spark, rows=ROWS, target=TARGET):
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA + ", Score int, `row` string, weight int")
    return docs.repartition(4), spark.createDataFrame([(t, 0) for t in target], "text string, bucket int")


@pytest.mark.parametrize("features", [Features(), Features(1, 50), Features(3, 1000)])
def test_equals_brute_force(spark, features):
    docs, target = frames(spark)
    gain = importance.gains(importance.bucket_counts(docs, features), importance.bucket_counts(target, features), features)
    scores = importance.scored(docs, gain, 7, features)
    assert set(scores.columns) == {"doc_id", "text", "row", "n_words", "n_features", "weight", "score"}
    out = importance.ranked(scores.drop("text", "row"), 25, 5)
    rows = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    assert sorted(rows, key=str) == brute(ROWS, TARGET, 25, 5, 7, features)


def test_blocks_of_long_texts_change_nothing(monkeypatch):
    text = ("Ab c " * 40 + "longword" * 30 + " é" * 50).encode()
    for width in (1, 2, 4):
        features = Features(width, 10_000)
        monkeypatch.setattr(importance, "BLOCK", 1 << 20)
        whole = [(n, sorted(b)) for n, b in features.of(text)]
        for size in (1, 3, 7, 64):
            monkeypatch.setattr(importance, "BLOCK", size)
            parts = list(features.of(text))
            assert len(parts) > 1 and sum(n for n, _ in parts) == whole[0][0]
            assert sorted(b for _, found in parts for b in found) == whole[0][1]


def test_resample_keeps_the_drawn_rows(spark):
    docs, target = frames(spark, [r for r in ROWS if r[0] is None or r[0] not in (5, 6)])
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(target))
    ranked = importance.ranked(importance.scored(docs, gain, 7).select("doc_id", "n_words", "score"), 25, 5)
    kept = importance.resample(docs, target, min_words=5)
    assert kept.columns == docs.columns
    drawn = ranked.where("rank is not null")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in drawn.collect())


def test_likelier_texts_are_drawn(spark):
    near = [(i, "science of the atom and the cell " * 5) for i in range(100)]
    far = [(100 + i, f"noise {i} about nothing in plain words {i} " * 5) for i in range(300)]
    docs, target = frames(spark, near + far, ["science of the atom", "the cell and the atom"] * 50)
    kept = [r.doc_id for r in importance.resample(docs, target).collect()]
    assert len(kept) == 100 and sum(i < 100 for i in kept) > 75


def test_empty_tables(spark):
    docs, target = frames(spark, [], [])
    gain = importance.gains(importance.bucket_counts(docs), importance.bucket_counts(target))
    assert gain == [0] * 10_000
    assert importance.ranked(importance.scored(docs, gain, 7).drop("text"), 25, 20).count() == 0
    assert importance.resample(docs, target).count() == 0
    some, _ = frames(spark)
    assert importance.resample(some, target, min_words=5).count() > 0
