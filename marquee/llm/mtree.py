"""Exact top-k by inner product in M-trees, one per shard.

Vectors get one more component that makes all of a shard equally long; then the largest inner product is the smallest
distance, and the triangle inequality holds. A tree has pages of entries: a pivot, the covering radius of what lies
below it, and its distance to the pivot of the page above. The search keeps pages in a heap by the best score they can
hold. On a page, the stored distances to the parent exclude entries before anything is computed; what is left gets its
distance, and a bound from its radius. The search ends when no page can hold a score that would enter. Bounds carry a
margin for rounding, scores are exact integers, and a page whose best is only equal is opened unless its smallest id
is too large to win the tie.

Trees are built per shard, written as rows (a page each), and sent to the tasks that answer blocks of queries.

Defined results: rows without an id, and vectors that are null, empty, or hold null or non-finite components, take no
part; repeated rows of an id and vector count once; a query meets only vectors of its length; sums beyond 64 bits wrap.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.vectors import KEY, search, shards, stacked, usable
from marquee.operators.settle import settle

PAGE = 512  # entries of a page
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
PAGE_SCHEMA = "dims int, shard int, page int, leaf boolean, least long, longest double, entries binary, radii binary, apart binary, below binary, counts binary"


def _distances(x: np.ndarray, y: np.ndarray, longest: float) -> np.ndarray:
    """Distances of vectors in the lengthened space."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    extra = np.sqrt(np.maximum(longest - a, 0))[:, None] - np.sqrt(np.maximum(longest - b, 0))[None, :]
    return np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * (x @ y.T), 0) + extra * extra)


class Builder:
    """Splits a shard's vectors around sampled pivots until each part fits on a page."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        self.vectors, self.ids, self.pages = vectors, ids, []
        self.x = vectors.astype(np.float64)
        self.longest = float((self.x * self.x).sum(1).max())  # squared
        self.rnd = np.random.default_rng(len(vectors))

    def add(self, rows: np.ndarray, pivot: np.ndarray) -> tuple[int, int]:
        """A page for ``rows`` below ``pivot``: its number and smallest id."""
        page = len(self.pages)
        self.pages.append(None)
        if len(rows) <= PAGE:
            least = int(min(self.ids[r][0] for r in rows))
            below, counts = np.concatenate([self.ids[r] for r in rows]), [len(self.ids[r]) for r in rows]
            entries, radii, leaf = rows, np.zeros(len(rows)), True
        else:
            entries = self.rnd.choice(rows, min(PAGE, -(-2 * len(rows) // PAGE)), replace=False)
            far = _distances(self.x[rows], self.x[entries], self.longest)
            nearest = far.argmin(1)
            if len(np.unique(nearest)) == 1:  # rounding makes them all alike
                nearest = np.arange(len(rows)) % len(entries)
            some = np.unique(nearest)
            radii = np.array([far[nearest == e, e].max() for e in some])
            children = [self.add(rows[nearest == e], self.x[entries[e]]) for e in some]
            entries, leaf = entries[some], False
            below, counts, least = np.array([c[0] for c in children]), [c[1] for c in children], min(c[1] for c in children)
        apart = _distances(self.x[entries], pivot[None, :], self.longest)[:, 0]
        self.pages[page] = (
            page, leaf, least, self.longest, self.vectors[entries].tobytes(), radii.tobytes(), apart.tobytes(),
            np.asarray(below, np.int64).tobytes(), np.asarray(counts, np.int64).tobytes(),
        )
        return page, least


def build(shard: pd.DataFrame) -> pd.DataFrame:
    vectors = stacked(shard["v"]).astype(np.int64)
    tree = Builder(vectors, [np.asarray(i, np.int64) for i in shard["ids"]])
    tree.add(np.arange(len(vectors)), np.zeros(vectors.shape[1]))
    pages = pd.DataFrame(tree.pages, columns=["page", "leaf", "least", "longest", "entries", "radii", "apart", "below", "counts"])
    return pages.assign(dims=shard["dims"].iloc[0], shard=shard["shard"].iloc[0])[[c.split()[0] for c in PAGE_SCHEMA.split(", ")]]


def _products(vectors: np.ndarray, some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of some vectors with ``x``; of most it is cheaper to take all than to copy them."""
    return (vectors @ x)[some] if 2 * len(some) > len(vectors) else vectors[some] @ x


class Tree:
    """A shard's pages, ready to be searched."""

    def __init__(self, pages: pd.DataFrame):
        dims = int(pages["dims"].iloc[0])
        self.longest, self.pages = float(pages["longest"].iloc[0]), {}
        for p in pages.itertuples():
            entries = np.frombuffer(p.entries, np.int64).reshape(-1, dims)
            x = entries.astype(np.float64)
            numbers = [np.frombuffer(a, t) for a, t in ((p.radii, "f8"), (p.apart, "f8"), (p.below, "i8"), (p.counts, "i8"))]
            self.pages[p.page] = (bool(p.leaf), entries, x, *numbers)
        self.exact = self.longest < 2.0**52  # products in double precision are then exact integers

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best ``k`` as (score, id)."""
        x = q.astype(np.float64)
        square = float(x @ x)
        exact = self.exact and square < 2.0**52 and self.longest * square < 2.0**104
        length, margin = np.sqrt(square), 1e-9 * (square + self.longest) + 1e-6
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its first is the worst
        heap = [(-np.inf, 0, 0, float(np.sqrt(square + self.longest)))]
        while heap:
            bound, least, page, to_pivot = heapq.heappop(heap)
            worst, worst_id = (best[0][0], -best[0][1]) if len(best) == k else (-np.inf, 0)
            if -bound < worst - margin:
                break
            if -bound + margin < worst + 1 and least > worst_id:  # can only tie, and would lose it
                continue
            leaf, entries, vectors, radii, apart, below, counts = self.pages[page]
            limit = np.sqrt(max(square + self.longest - 2 * worst, 0)) + margin if worst > -np.inf else np.inf
            near = np.flatnonzero(np.abs(to_pivot - apart) - radii <= limit)
            if not len(near):
                continue
            if leaf:
                scores = _products(vectors, near, x) if exact else entries[near] @ q
                starts = np.cumsum(counts) - counts
                for at in np.flatnonzero(scores >= worst):
                    start = starts[near[at]]
                    for vec_id in below[start : start + counts[near[at]]].tolist():
                        entry = (int(scores[at]), -vec_id)
                        if vec_id == query_id:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                        else:
                            break
                continue
            products = _products(vectors, near, x)
            far = np.sqrt(np.maximum(square + self.longest - 2 * products, 0))
            closest = np.maximum(far - radii[near], 0)
            bounds = np.minimum(products + length * radii[near], (square + self.longest - closest * closest) / 2)
            for at in np.flatnonzero(bounds >= worst - margin):
                e = near[at]
                heapq.heappush(heap, (-float(bounds[at]), int(counts[e]), int(below[e]), float(far[at])))
        return sorted(((s, -i) for s, i in best), key=lambda t: (-t[0], t[1]))


def quantised(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x * 256.0))


def exact_top_k(rows: DataFrame, every: int = 50, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For every row whose vec_id is divisible by ``every``: rank, vec_id and score of the ``k`` best other rows."""
    good = usable(rows).withColumn("v", quantised(F.col("v")))
    dealt, n = shards(good, k + 1, shard_rows)
    index = dealt.groupBy(*KEY).applyInPandas(build, PAGE_SCHEMA)

    def answer(pages: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        tree, out = Tree(pages), []
        for query_id, v in zip(block["query_id"], block["v"], strict=True):
            out += [(query_id, vec_id, score) for score, vec_id in tree.top(int(query_id), np.asarray(v, np.int64), k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    queries = good.where(F.col("vec_id") % every == 0)
    return search(settle(index, "mtree"), queries, n, BLOCK_ROWS, answer, k, "long")
