"""Approximate nearest neighbours by a robust-pruned directed graph in every shard, largest inner product first.

Vectors are dealt into bands of nearly equal length (longest to shortest at most ``RATIO``), and a large band by hash into
shards. In a shard they get one more component that makes all equally long, so that the largest inner product is the
smallest distance; within a band that component is small, and the graph keeps to the directions. Points enter the graph in batches that double: a beam search over the graph so far proposes
neighbours, and pruning keeps the nearest of them, drops what lies nearer to it (by the factor ``ALPHA``) than to the
point, and goes on with the rest. Reverse edges are added and pruned alike. A query runs a beam search in the shards of
the longest bands; what the beam holds is scored exactly in double precision. No product with a vector is above the
product of both lengths, so of the other bands a query visits those whose longest vector could still beat the last of
the ``k`` scores it has; skipping the rest loses nothing. The best of all shards are merged.

All queries of a block step together, in arrays. Every vector is indexed. A shard that fits into the beam is searched
whole, so few candidates are all returned.

Defined results: rows without an id, and vectors that are null, empty, zero, or hold null or non-finite components,
take no part; repeated rows of an id and vector count once; a query meets only vectors of its length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.vectors import best, distinct_vectors, log_length, stacked, usable
from marquee.operators.settle import settle

DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
STARTS = 16  # points a search begins at, besides the central one
WIDE = 4  # points of a beam opened in one step
BATCH = 256
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
PAGE = 512  # points in a row of the index
RATIO = 1.2  # of the longest to the shortest vector of a band
AHEAD = 512  # vectors in the bands that all queries visit, at least
SLACK = 1e-9  # relative, for rounding in the bound
KEY = ["dims", "band", "split"]
INDEX_SCHEMA = "dims int, band int, split int, first int, vectors binary, near binary, ids binary, counts binary"


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors in a unit that suits them, with one more component, all of the length of the longest."""
    vectors = vectors / np.abs(vectors).max()
    squares = (vectors * vectors).sum(1)
    return np.hstack([vectors, np.sqrt(squares.max() - squares)[:, None]]).astype(np.float32)


class Graph:
    def __init__(self, x: np.ndarray, near: np.ndarray | None = None):
        self.x, n = x, len(x)
        self.near = np.full((n, DEGREE), -1, np.int32) if near is None else near
        self.degree = (self.near >= 0).sum(1)
        rnd = np.random.default_rng(n)
        self.order = rnd.permutation(n)
        middle = int(np.argmax(x @ x.mean(0)))
        self.starts = np.unique(np.r_[middle, rnd.choice(n, min(n, STARTS), replace=False)])

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The points a beam of ``width`` ends with (-1: none) and their products, largest first."""
        n, b = len(self.x), len(queries)
        first = np.arange(n) if n <= width else self.starts
        ids = np.full((b, width), -1, np.int32)
        products = np.full((b, width), -np.inf, np.float32)
        ids[:, : len(first)] = first
        products[:, : len(first)] = queries @ self.x[first].T
        opened = ids < 0
        seen = np.zeros((b, n), bool)
        seen[:, first] = True
        rows = np.arange(b)
        while len(rows):
            hope = np.where(opened[rows], -np.inf, products[rows])
            pick = np.argpartition(-hope, min(WIDE, width - 1), axis=1)[:, :WIDE]
            some = np.take_along_axis(hope, pick, 1) > -np.inf
            go = some.any(1)
            rows, pick, some = rows[go], pick[go], some[go]
            if not len(rows):
                break
            opened[rows[:, None], pick] = True
            chosen = np.where(some, ids[rows[:, None], pick], -1)
            found = np.where(chosen[:, :, None] >= 0, self.near[chosen], -1).reshape(len(rows), -1)
            found.sort(1)
            new = found >= 0
            new[:, 1:] &= found[:, 1:] != found[:, :-1]
            new &= ~seen[rows[:, None], found]
            r, c = np.nonzero(new)
            seen[rows[r], found[r, c]] = True
            got = np.full(found.shape, -np.inf, np.float32)
            got[r, c] = np.einsum("ij,ij->i", self.x[found[r, c]], queries[rows[r]])
            all_ids = np.hstack([ids[rows], np.where(new, found, -1)])
            all_products = np.hstack([products[rows], got])
            all_opened = np.hstack([opened[rows], ~new])
            best = np.argpartition(-all_products, width - 1, axis=1)[:, :width]
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            products[rows] = np.take_along_axis(all_products, best, 1)
            opened[rows] = np.take_along_axis(all_opened, best, 1)
        order = np.argsort(-products, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(products, order, 1)

    def prune(self, points: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Robust pruning: up to DEGREE of ``found`` (-1: none) for each point, -1 behind them."""
        valid = (found >= 0) & (found != points[:, None])
        others = self.x[found]
        square = float(self.x[0] @ self.x[0])
        away = np.where(valid, 2 * (square - np.einsum("bcd,bd->bc", others, self.x[points])), np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        found, away = np.take_along_axis(found, order, 1), np.take_along_axis(away, order, 1)
        others = np.take_along_axis(others, order[:, :, None], 1)
        between = 2 * (square - others @ others.transpose(0, 2, 1))
        alive, rows = np.isfinite(away), np.arange(len(points))
        out = np.full((len(points), DEGREE), -1, np.int32)
        for at in range(DEGREE):
            has = alive.any(1)
            if not has.any():
                break
            pick = alive.argmax(1)
            out[has, at] = found[rows, pick][has]
            alive &= ALPHA * ALPHA * between[rows, pick] > away
            alive[rows, pick] = False
        return out

    def insert(self, points: np.ndarray) -> None:
        found, _ = self.beam(self.x[points], min(BUILD_BEAM, len(self.x)))
        chosen = self.prune(points, found)
        self.near[points], self.degree[points] = chosen, (chosen >= 0).sum(1)
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], points[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, start, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, counts)
        most = int(counts.max()) if len(counts) else 0
        fits = np.repeat(self.degree[nodes] + counts <= DEGREE, counts)
        self.near[target[fits], self.degree[target[fits]] + place[fits]] = source[fits]
        full = self.degree[nodes] + counts > DEGREE
        self.degree[nodes[~full]] += counts[~full]
        lists = np.full((len(nodes), most), -1, np.int32)
        lists[np.repeat(np.arange(len(nodes)), counts), place] = source
        nodes, lists = nodes[full], lists[full]
        step = max(1, 2_000_000 // (DEGREE + most) ** 2)
        for at in range(0, len(nodes), step):
            some = nodes[at : at + step]
            kept = self.prune(some, np.hstack([self.near[some], lists[at : at + step]]))
            self.near[some], self.degree[some] = kept, (kept >= 0).sum(1)

    def build(self) -> Graph:
        order = np.r_[self.starts, self.order[~np.isin(self.order, self.starts)]]
        done = len(self.starts)
        ring = np.arange(done)
        for step in range(1, min(done, DEGREE)):  # the starts know each other
            self.near[self.starts, step - 1] = self.starts[(ring + step) % done]
        self.degree[self.starts] = (self.near[self.starts] >= 0).sum(1)
        while done < len(order):
            batch = order[done : done + min(done, BATCH)]
            self.insert(batch)
            done += len(batch)
        return self


def build(shard: pd.DataFrame) -> pd.DataFrame:
    vectors = stacked(shard["v"]).astype(np.float64)
    graph, out = Graph(lengthened(vectors)).build(), []
    for at in range(0, len(vectors), PAGE):
        ids = [np.asarray(i, np.int64) for i in shard["ids"].iloc[at : at + PAGE]]
        out.append((
            *(shard[name].iloc[0] for name in KEY), at, vectors[at : at + PAGE].tobytes(),
            graph.near[at : at + PAGE].tobytes(), np.concatenate(ids).tobytes(),
            np.array([len(i) for i in ids], np.int64).tobytes(),
        ))
    return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def _bands(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """Per dimension and band the number of ``splits``, the ``longest`` vector, and whether all queries visit it."""
    bands = vectors.groupBy("dims", "band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    longer = Window.partitionBy("dims").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(longer), F.lit(0)) < AHEAD
    return bands.select("dims", "band", F.ceil(F.col("n") / shard_rows).cast("int").alias("splits"), "longest", ahead.alias("ahead"))


def _visits(asked: DataFrame, index: DataFrame, n_blocks: int, answer: Callable) -> DataFrame:
    """``answer`` for the shards that the blocks of ``asked`` queries visit: query_id, vec_id, score."""
    key = [*KEY, "block"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
    paged = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(pages: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(pages) and len(block):
            return answer(pages, block)
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": []})

    return paged.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")


def _searcher(k: int, beam: int) -> Callable:
    def answer(pages: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("first")
        vectors = np.concatenate([np.frombuffer(b, "f8").reshape(-1, int(pages["dims"].iloc[0])) for b in pages["vectors"]])
        near = np.concatenate([np.frombuffer(b, "i4").reshape(-1, DEGREE) for b in pages["near"]])
        ids = np.concatenate([np.frombuffer(b, "i8") for b in pages["ids"]])
        counts = np.concatenate([np.frombuffer(b, "i8") for b in pages["counts"]])
        starts = np.cumsum(counts) - counts
        graph, asked, parts = Graph(lengthened(vectors), near), stacked(block["v"]).astype(np.float64), []
        for at in range(0, len(asked), BATCH):
            q = asked[at : at + BATCH]
            longer = np.hstack([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))]).astype(np.float32)
            found, _ = graph.beam(longer, max(beam, 2 * k))
            scores = np.where(found >= 0, (vectors[found] * q[:, None, :]).sum(2), -np.inf)
            for row, query_id in enumerate(block["query_id"].iloc[at : at + BATCH]):
                order = np.argsort(-scores[row], kind="stable")
                least = scores[row][order[min(k, len(order) - 1)]]  # k + 1 vectors, and what equals the last
                order = order[(scores[row][order] >= least) & (found[row][order] >= 0)]
                where = found[row][order]
                out = np.concatenate([ids[starts[w] : starts[w] + counts[w]] for w in where]) if len(where) else ids[:0]
                score = np.repeat(scores[row][order], counts[where])
                mine = out != query_id
                out, score = out[mine], score[mine]
                top = np.lexsort((out, -score))[:k]
                parts.append(pd.DataFrame({"query_id": query_id, "vec_id": out[top], "score": score[top]}))
        return pd.concat(parts)

    return answer


def nearest(rows: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For every row whose vec_id is divisible by ``every``: rank, vec_id and score of the ``k`` nearest rows found."""
    good = usable(rows, zero=False)
    log = log_length(F.col("v"))
    # A band is centred on a length of one, so that vectors of that length lie in one band whatever their rounding.
    vectors = distinct_vectors(good, k + 1).select(
        "v", "ids", F.size("v").alias("dims"), F.floor(log / math.log(RATIO) + 0.5).cast("int").alias("band"), F.exp(log).alias("length")
    )
    bands = settle(_bands(vectors, shard_rows), "bands")
    dealt = vectors.join(bands.select("dims", "band", "splits"), ["dims", "band"])
    dealt = dealt.select("dims", "band", F.pmod(F.xxhash64("v"), F.col("splits")).cast("int").alias("split"), "v", "ids")
    index = settle(dealt.groupBy(*KEY).applyInPandas(build, INDEX_SCHEMA), "graph")

    queries = good.where(F.col("vec_id") % every == 0).distinct().select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dims"), F.exp(log).alias("length")
    )
    queries = settle(queries, "queries")
    n_blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    split = F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split")
    everywhere = queries.join(bands.where("ahead"), "dims").select("query_id", "v", "dims", "band", split)
    first = settle(best(_visits(everywhere, index.join(bands.where("ahead").select("dims", "band"), ["dims", "band"], "left_semi"),
                                n_blocks, _searcher(k, beam)), k), "found")

    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("last"))
    open_ = queries.join(last, F.col("query_id") == F.col("of"), "left").join(bands.where(~F.col("ahead")), "dims")
    could = F.col("last").isNull() | (queries["length"] * F.col("longest") * (1 + SLACK) >= F.col("last"))
    some = open_.where(could).select("query_id", "v", "dims", "band", split)
    second = _visits(some, index.join(bands.where(~F.col("ahead")).select("dims", "band"), ["dims", "band"], "left_semi"),
                     n_blocks, _searcher(k, beam))
    return best(first.drop("rank").unionByName(second), k)
