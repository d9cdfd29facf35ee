from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from marquee.llm import jaccard, shingles
from marquee.llm.jaccard import Similarity, groups, keep_one
from tests.llm.brute import near_copies

SCHEMA = "doc_id long, text string, shingle string, node int"


def texts(seed: int) -> list[tuple[int, str | None]]:
    """Groups of near copies with few to many edits, exact copies, a common passage, and odd rows."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(12)]
    out: list[str | None] = [None, "", " \t\n", "one", "One", "one two", "é two three", "x" * 3000, "a\x0bb c d e"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 8, 30, 120, 200]))] + passage * rnd.randint(0, 1)
        for _ in range(rnd.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 20))):
                at = rnd.randrange(len(copy))
                kind = rnd.random()
                if kind < 0.4:
                    copy[at] = rnd.choice(words)
                elif kind < 0.7 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rnd.choice(words))
            out.append(rnd.choice([" ", "\n", "  "]).join(copy) if rnd.random() < 0.8 else " ".join(copy).upper())
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,like", [(1, Similarity(4, 85, 100)), (2, Similarity(5, 4, 5)), (3, Similarity(4, 85, 100))])
def test_groups_equal_brute_force(spark, seed, like):
    rows = texts(seed)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in groups(docs, like).collect()}
    assert found == near_copies(rows, like.width, like.over, like.under)


def test_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, "z"), (7, None), (8, "")]
    docs = spark.createDataFrame([(k, t, "s", 9) for k, t in rows], SCHEMA)
    found = sorted(map(tuple, groups(docs).collect()), key=str)
    assert found == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (7, 0, 7), (8, 0, 8)], key=str)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(1, "A b c d e f"), (None, "z"), (7, None), (8, "")], key=str
    )


def test_of_copies_without_ids_one_stays(spark):
    copies = [(None, "one two three four five six", source) for source in ("a", "b", "b", "c")]
    rows = [*copies, (None, "something else that is not a copy of it", "a"), (4, "yet another text with an id of its own", None)]
    docs = spark.createDataFrame([*rows, (5, "Yet another text with an id of its own", "z")], "doc_id long, text string, source string")
    kept = sorted([(r.doc_id, (r.text or "")[:9].lower()) for r in keep_one(docs).collect()], key=str)
    assert kept == [(4, "yet anoth"), (None, "one two t"), (None, "something")]
    again = keep_one(docs.repartition(4)).collect()
    assert sorted(map(str, again)) == sorted(map(str, keep_one(docs).collect()))


def test_runs_of_shingles_in_batches():
    """Heads, dropped single rows and repeated nodes are the same however the sorted rows are cut into batches."""
    rnd = random.Random(2)
    rows, want = [], []
    for shingle in range(60):
        nodes = [rnd.randbytes(16) for _ in range(rnd.choice([1, 1, 2, 3, 9]))]
        run = [(shingle, node, rnd.randrange(50), rnd.randrange(99), rnd.randrange(5)) for node in nodes]
        rows += [row for row in run for _ in range(rnd.choice([1, 1, 3]))]
        want += [(*row, run[0][1], run[0][2], run[0][3]) for row in run if len(run) > 1]
    kinds = jaccard.LIVE
    table = pa.Table.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], names=kinds.names[:5])
    for size in (1, 2, 3, 7, 50, 1000):
        runs, found = jaccard._Runs(), []
        for batch in table.to_batches(max_chunksize=size):
            out = runs.shared(batch)
            found += [tuple(r.values()) for r in out.to_pylist()] if out is not None else []
        # A head is written with the first row that follows it, which may be of a later batch.
        assert sorted(found) == sorted(want), size


def test_pairs_of_a_large_group_and_an_outsider(spark):
    """A group of many different sets shares a rare passage with other texts; links across groups are all found."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[:30] + [f"o{i}w{j}" for j in range(40)])) for i in range(10)]
    rows += [(200 + i, " ".join(base[:60] + [f"q{j}" for j in range(i)])) for i in range(8)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in groups(docs, Similarity(4, 85, 100)).collect()}
    assert found == near_copies(rows, 4, 85, 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert groups(docs).count() == 0 and keep_one(docs).count() == 0


def test_long_text_in_blocks():
    rnd = random.Random(0)
    text = " ".join(rnd.choice(["aa", "b", "Ccc", "é", "w" * 50]) + str(rnd.randrange(10**6)) for _ in range(300_000))
    giant = "y" * (3 << 20) + " tail " + "z" * 10
    whole = list(shingles.shingle_sets(pa.array([text, giant, None, "q"]), 4, shingles.Hasher()))
    hasher = shingles.Hasher()
    data = np.frombuffer(text.encode(), np.uint8)
    words = hasher.text_words(data)
    assert len(words) == 300_000
    assert (whole[0] == shingles.shingle_set(words, 4)).all()
    assert [len(w) for w in whole[1:]] == [1, 0, 1]


def test_words_of_any_length(monkeypatch):
    """Numbers of words do not depend on where blocks end."""
    text = ("ab " * 30 + "word" * 50 + "  é日 " + "x" * 97 + " y").encode()
    data = np.frombuffer(text, np.uint8)
    whole = shingles.Hasher().words(data, np.array([len(data)]))[0]
    assert len(whole) == 34 and len(set(whole.tolist())) == 5
    for size in (1, 2, 3, 10, 64, 200):
        monkeypatch.setattr(shingles, "BLOCK", size)
        assert shingles.Hasher().text_words(data).tolist() == whole.tolist()
