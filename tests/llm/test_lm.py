from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import lm, shingles
from marquee.llm.queries import QUERIES
from tests.llm.brute import WORD, lower_ascii

BEGIN, END = ("begin",), ("end",)


def fold(doc_id):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


class Plain:
    """The same model over dictionaries."""

    def __init__(self, sequences, order):
        self.order, self.grams = order, Counter()
        for tokens in sequences:
            padded = [BEGIN] * (order - 1) + tokens
            for n in range(1, order + 1):
                for at in range(order - 1, len(padded)):
                    self.grams[tuple(padded[at - n + 1 : at + 1])] += 1
            for n in range(1, order):
                self.grams[(BEGIN,) * n] += 1
        self.tokens = sum(map(len, sequences))
        self.words = len({t for tokens in sequences for t in tokens})

    def places(self, tokens):
        """Bucket and estimates of every token."""
        padded = [BEGIN] * (self.order - 1) + tokens
        for at in range(self.order - 1, len(padded)):
            shares, bucket = [1 / (self.words + 1)], 0
            for n in range(1, self.order + 1):
                gram = tuple(padded[at - n + 1 : at + 1])
                history = self.tokens if n == 1 else self.grams[gram[:-1]]
                shares.append(self.grams[gram] / history if history else 0.0)
                if history:
                    bucket = (n - 1) * lm.POWERS + history.bit_length() - 1
            yield bucket, shares


def mixture(plain, held):
    rows = Counter((bucket, tuple(shares)) for tokens in held for bucket, shares in plain.places(tokens))
    weights = {b: [1 / (2 + b // lm.POWERS) if j < 2 + b // lm.POWERS else 0.0 for j in range(plain.order + 1)] for b, _ in rows}
    before = None
    for _ in range(lm.ROUNDS):
        sums, held_in, fit = {b: [0.0] * (plain.order + 1) for b in weights}, Counter(), 0.0
        for (b, shares), n in rows.items():
            parts = [w * s for w, s in zip(weights[b], shares)]
            held_in[b] += n
            fit += n * math.log(sum(parts))
            for j, part in enumerate(parts):
                sums[b][j] += n * part / sum(parts)
        for b in weights:
            known = 2 + b // lm.POWERS
            weights[b] = [(sums[b][j] + 1) / (held_in[b] + known) if j < known else 0.0 for j in range(plain.order + 1)]
        fit /= sum(held_in.values()) or 1
        if before is not None and fit - before < lm.ENOUGH:
            break
        before = fit
    return lm._spread(weights, plain.order)


def brute(rows, order):
    sequences = [WORD.findall(lower_ascii(text or "")) + [END] for _, text in rows]
    train = [s for (k, _), s in zip(rows, sequences) if fold(k) != 2]
    kept = [s for (k, _), s in zip(rows, sequences) if fold(k) not in (2, 3)]
    weights = mixture(Plain(kept, order), [s for (k, _), s in zip(rows, sequences) if fold(k) == 3])
    model, out = Plain(train, order), []
    for (doc_id, _), tokens in zip(rows, sequences):
        counts = [model.grams[(t,)] for t in tokens]
        base = sum(math.log10((c + 1) / (model.tokens + model.words + 1)) for c in counts)
        score = 0.0
        if model.tokens:
            score = sum(math.log10(sum(w * s for w, s in zip(weights[b], shares))) for b, shares in model.places(tokens))
        out.append((doc_id, fold(doc_id) == 2, len(tokens), sum(c > 0 for c in counts), model.tokens, base, score))
    return out


def order_of(row):
    return str(row[:5]), round(row[5], 6), round(row[6], 6)


def same(found, want):
    found, want = sorted(map(tuple, found), key=order_of), sorted(want, key=order_of)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def scores(spark, rows, order=2):
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, Role int, `block` string, serial int")
    at = lm.remainder(F.col("doc_id"))
    return lm.score(docs.repartition(3), at == 2, at == 3, order=order).collect()


SOME = ["The cat sat on the mat", "the dog sat on the cat \t and THE dog", "a b", "É é 日本 the", "", None, " \n ", "rare words only once here"]
ROWS = [(i, f"{SOME[i % 8]} w{i % 9} x{i}" if SOME[i % 8] else SOME[i % 8]) for i in range(150)]
ROWS += [(None, "the cat"), (None, "the cat"), (5, "the dog sat"), (5, "the dog sat"), (400, "long " * 900 + "w1 " * 300), (401, "y" * 5000)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, order):
    same(scores(spark, ROWS, order), brute(ROWS, order))


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are absent")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    same(QUERIES["op13_lm"](spark, folder).collect(), brute([tuple(r) for r in docs], 2))


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    """Blocks in this process: counts by n-gram are the same however texts are cut."""
    texts = [t.encode() for t in ["one two three four five six seven " * 9, "", "   ", "giantword" * 9, "a b " + " " * 70 + "c", "é 日本 x"]]

    def grams(size, order):
        monkeypatch.setattr(lm, "BLOCK_BYTES", size)
        hasher, block = shingles.Hasher(), lm._Block(0, 0)
        for serial, text in enumerate(texts):
            for piece in lm._pieces(text, order, hasher):
                block.add(*piece, serial, serial)
        row = next(lm._rows(block.row(pa.int64())))
        found = lm.Grams(row, order, hasher)
        counts = [Counter() for _ in range(order)]
        for n in range(order):
            for number, times in zip(found.unique[n].tolist(), found.times[n].tolist()):
                if times:
                    counts[n][number] += times
        return len(block.pieces), counts, len(found.scored)

    for order in (1, 2, 3):
        whole = grams(1 << 20, order)
        for size in (1, 5, 20):
            parts = grams(size, order)
            assert parts[0] > whole[0] == len(texts) and parts[1:] == whole[1:]


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary and one unseen word, after a seen and an unseen history."""
    texts = [(i, f"{'a b' if i % 3 else 'b c'} {'d' if i % 2 else 'a'}") for i in range(60)]
    held = next(i for i in range(1000, 1100) if fold(i) == 2)
    words = ["a", "b", "c", "d"]
    model = Plain([t.split() + [END] for k, t in texts if fold(k) != 2], 2)
    assert model.words == 5
    same(scores(spark, texts + [(held, w) for w in words]), brute(texts + [(held, w) for w in words], 2))
    weights = mixture(Plain([t.split() + [END] for k, t in texts if fold(k) not in (2, 3)], 2), [t.split() + [END] for k, t in texts if fold(k) == 3])
    for history in ("a", "unseen"):
        total = 0.0
        for token in [*words, END, "new"]:
            bucket, shares = list(model.places([history, token]))[1]
            total += sum(w * s for w, s in zip(weights[bucket], shares))
        assert total == pytest.approx(1.0)


def test_empty_tables_and_nothing_to_learn_from(spark):
    assert scores(spark, []) == []
    unseen = [i for i in range(100) if fold(i) == 2][:3]
    same(scores(spark, [(i, "a b") for i in unseen]), [(i, True, 3, 0, 0, 0.0, 0.0) for i in unseen])
    deleted = [i for i in range(100) if fold(i) == 3][:3]
    same(scores(spark, [(i, "a b") for i in deleted]), brute([(i, "a b") for i in deleted], 2))


def test_a_better_model_than_single_tokens(spark):
    rows = [(i, "in the beginning was the word and the word was good " * 3) for i in range(60)]
    found = scores(spark, rows)
    assert all(r.score > r.base_score for r in found)
