from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from marquee.llm import graph, mtree

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", 1) for i, v in rows], SCHEMA).repartition(3)


def random_rows(seed, n, dims):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + 0.3 * rnd.normal(size=dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # equal vectors
    rows += [(n + 100, None), (n + 101, []), (n + 102, [1.0] + [None] * (dims - 1)), (n + 103, [math.nan] * dims)]
    rows += [(n + 104, [math.inf] * dims), (n + 105, [0.0] * dims), (None, rows[0][1]), (rows[5][0], rows[5][1])]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, every, k, value, zero):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            good[i] = value(np.array(v, np.float64))
    out = {}
    for q, x in good.items():
        if q % every == 0:
            scores = sorted(((-(x * y).sum(), i) for i, y in good.items() if i != q and len(y) == len(x)))[:k]
            out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("seed,n,dims,page", [(1, 600, 8, 16), (2, 300, 3, 4), (3, 700, 24, 512)])
def test_m_tree_is_exact(spark, monkeypatch, seed, n, dims, page):
    rows = random_rows(seed, n, dims)
    dims_other = [(10_000 + i, [float(i), 1.0]) for i in range(12)] if dims != 2 else []
    want = brute(rows + dims_other, 10, 5, lambda v: np.floor(256 * v).astype(np.int64), zero=True)
    monkeypatch.setattr(mtree, "PAGE", page)
    found = answers(mtree.exact_top_k(table(spark, rows + dims_other), 10, 5, shard_rows=200))
    assert found == {q: v for q, v in want.items() if v}


def test_m_tree_prunes():
    rnd = np.random.default_rng(0)
    x = np.floor(256 * (rnd.normal(size=(20, 16))[rnd.integers(0, 20, 4000)] * 4 + rnd.normal(size=(4000, 16)) * 0.1)).astype(np.int64)
    frame = pd.DataFrame({"v": list(x), "ids": [[i] for i in range(4000)], "dims": 16, "shard": 0})
    tree, opened = mtree.Tree(mtree.build(frame)), []

    class Pages(dict):
        def __getitem__(self, page):
            opened.append(page)
            return super().__getitem__(page)

    tree.pages = Pages(tree.pages)
    assert tree.top(0, x[0], 5) == sorted(((int(s), i) for i, s in enumerate(x @ x[0]) if i), key=lambda t: (-t[0], t[1]))[:5]
    assert len(opened) < len(tree.pages) / 2


def test_graph_recall_and_scores(spark):
    rows = random_rows(4, 1500, 24)
    want = brute(rows, 10, 10, lambda v: v, zero=False)
    found = answers(graph.nearest(table(spark, rows), 10, 10, shard_rows=500))
    assert set(found) == set(want)
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    by_id = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v}
    for q, best in found.items():
        assert [r for r, _, _ in best] == list(range(1, 11)) and q not in {i for _, i, _ in best}
        for _, i, score in best:
            assert score == pytest.approx(float(by_id[q] @ by_id[i]), abs=1e-12)
        assert sorted(best, key=lambda b: (-b[2], b[1])) == best


@pytest.mark.parametrize("case", ["0.2", "0.5", "1.0", "unit", "one_long"])
def test_graph_recall_on_unequal_lengths(spark, case):
    """Full shards of vectors in all directions, of log-normal length, or of length one but for one."""
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(8192 if case in ("unit", "one_long") else 4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "one_long":
        x[11] *= 10_000
    elif case != "unit":
        x *= np.exp(float(case) * rnd.normal(size=(len(x), 1)))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))})).repartition(4)
    found = answers(graph.nearest(rows, 32, 20))
    hits = 0
    for q in range(0, len(x), 32):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(found[q]) == 20 and sorted(found[q], key=lambda b: (-b[2], b[1])) == found[q]
        hits += len({i for _, i, _ in found[q]} & set(np.argsort(-scores)[:20].tolist()))
    print(f"recall {case}: {hits / (len(found) * 20):.4f}")
    assert hits >= 0.9 * len(found) * 20


def test_bands_are_skipped_exactly(spark, monkeypatch):
    """Few vectors ahead, so most bands are visited or skipped by the bound; every shard is searched whole."""
    monkeypatch.setattr(graph, "AHEAD", 5)
    rnd = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rnd.normal(size=(300, 4)) * np.exp(2 * rnd.normal(size=(300, 1))))]
    rows += [(1000 + i, [1e200 * (i + 1), 0.0, 0.0, 0.0]) for i in range(3)] + [(2000, [0.0, 1e-300, 0.0, 0.0]), (2001, [-1.0, 0.5])]
    rows = [(i, v) for i, v in rows if not (i >= 1000 and i % 10 == 0 and i < 2000)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = answers(graph.nearest(table_, 10, 5)), brute(rows, 10, 5, lambda v: v, zero=False)
    assert {q: [b[1] for b in v] for q, v in found.items()} == {q: [b[1] for b in v] for q, v in want.items() if v}


def test_few_candidates_are_all_returned(spark):
    rows = [(i, [float(i + 1), 2.0]) for i in range(9)]
    for found in (answers(graph.nearest(table(spark, rows), 3, 20)), answers(mtree.exact_top_k(table(spark, rows), 3, 20))):
        assert {q: len(v) for q, v in found.items()} == {0: 8, 3: 8, 6: 8}


def test_empty_table(spark):
    empty = table(spark, [])
    assert graph.nearest(empty).count() == 0 and mtree.exact_top_k(empty).count() == 0
