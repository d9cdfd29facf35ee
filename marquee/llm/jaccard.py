"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

Texts with the same set of shingles are one node. A node's shingles are ordered by how frequent they are in the corpus
(rarest first). If two sets reach the similarity, their prefixes of length n - ceil(t n) + m share m shingles or more,
for every m. Each node chooses its own m by what its prefix would cost, the partners to be expected; a pair must share
as many prefix shingles as the smaller of the two asks for, before it is verified on the whole sets.

Frequencies are counts in a sketch of fixed size over all texts: any order is right, a good one is fast. Links are only
needed for groups, and a group of near copies has too many to list. So the members of a prefix shingle are first
verified against its most typical member; groups are formed; and then all pairs of different groups that the prefixes
allow are verified: of each shingle first the pairs of groups, then their members. No link between groups is lost, pairs
within a group are not made.

Bounds: the sketch (``SKETCH_BITS``) and the bitmap of representatives (``BITMAP_BITS``) are of fixed size and the only
things broadcast. Everything else is shuffled by shingle or node, and runs of a hot shingle are streamed in arrays. A
task sends the prefix of a set once, however many copies it holds, and copies meet their group as one row a node.

Defined results: null, empty and blank texts have an empty set, and are linked with nothing; texts with fewer words
than the width have one shingle; equal rows are linked; a row without an id takes part, and the group's id is the
smallest id in it, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import shingles
from marquee.llm.components import components
from marquee.operators.settle import passing, settle

SKETCH_BITS = 20  # counters, 4 bytes each
SKETCH_ROW = 4096  # counters in a row of the sketch table
BITMAP_BITS = 23
STEP = 6  # prefix shingles for each match that is asked for in any case
CHEAP = 32.0  # expected partners of a prefix up to which no more is asked for
MOST_MATCHES = 12
ROWS = 4096  # rows in an output batch
KNOWN_NODES = 1 << 18  # sets whose prefixes a task remembers to have sent
BATCH_ROWS = 1000  # texts, or pairs of sets, in an input batch
SET_SCHEMA = "id long, n long, node binary, part int, counts binary"
PREFIX_SCHEMA = "shingle long, node binary, place int, n long, matches int, typical double"


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``width`` words; sets are similar from ``over`` / ``under`` on."""

    width: int = 5
    over: int = 4
    under: int = 5

    def least(self, n):
        """How many shingles a set of ``n`` must share with any similar one; of a number or a column."""
        if isinstance(n, Column):
            return F.ceil(n * self.over / self.under).cast("long")
        return -(-self.over * n // self.under)

    def asked(self, n):
        """How many matches a set of ``n`` asks for in any case; never falls with ``n``."""
        extra = n - self.least(n)
        if isinstance(n, Column):
            return F.least(F.floor(extra / STEP) + 1, F.lit(MOST_MATCHES))
        return min(extra // STEP + 1, MOST_MATCHES)


def _sets(texts: DataFrame, like: Similarity) -> DataFrame:
    """A row per text, and the rows of the sketch: counts of shingles by the last bits of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = shingles.Hasher(), np.zeros(1 << SKETCH_BITS, np.uint32)
        mask = np.uint64(len(counts) - 1)
        for batch in batches:
            sizes, nodes = [], []
            for found in shingles.shingle_sets(batch.column("text"), like.width, hasher):
                np.add.at(counts, (found & mask).astype(np.int64), 1)
                sizes.append(len(found))
                nodes.append(shingles.set_key(found) if len(found) else None)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["id", "n", "node", "part", "counts"],
            )
        parts = [(i, row) for i, row in enumerate(counts.reshape(-1, SKETCH_ROW)) if row.any()]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
             pa.array([i for i, _ in parts], pa.int32()), pa.array([row.tobytes() for _, row in parts], pa.binary())],
            ["id", "n", "node", "part", "counts"],
        )

    return texts.mapInArrow(run, SET_SCHEMA)


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all sketches: added up in the tasks, one row of counters per part for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                row = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.float32)
                sums[part] = sums[part] + row if part in sums else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["part", "counts"],
        )

    parts = rows.where(F.col("part").isNotNull()).select("part", "counts").repartition("part")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW, np.float32).reshape(-1, SKETCH_ROW)
    for row in parts.mapInArrow(add, "part int, counts binary").collect():  # at most 4 bytes a counter
        out[row.part] = np.frombuffer(row.counts, np.float32)
    return out.ravel()


def matches_wanted(expected: np.ndarray, shortest: int, longest: int) -> int:
    """How many matches a prefix asks for, by the partners that its shingles lead to."""
    cost, wanted = float(expected.sum()), shortest
    while wanted < longest and cost / wanted > CHEAP:
        wanted += 1
    return wanted


def _prefixes(spark: SparkSession, texts: DataFrame, sketch: np.ndarray, like: Similarity) -> DataFrame:
    """(shingle, node) of every text's prefix, with what the node asks for and how typical its prefix is."""
    shared = spark.sparkContext.broadcast(sketch)  # 4 bytes a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = shingles.Hasher(), shared.value
        mask, noise = np.uint64(len(counts) - 1), float(counts.mean())
        sent: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for found in shingles.shingle_sets(batch.column("text"), like.width, hasher):
                node = shingles.set_key(found) if len(found) else None
                if node is None or node in sent:
                    continue
                if len(sent) == KNOWN_NODES:
                    sent.clear()
                sent.add(node)
                often = counts[(found & mask).astype(np.int64)]
                n, least = len(found), like.least(len(found))
                shortest, longest = like.asked(n), min(2 * MOST_MATCHES, least)
                order = np.argsort(often, kind="stable")[: n - least + longest]  # equal counts: by number
                expected = np.maximum(often[order] - 1 - noise, 0)
                matches = matches_wanted(expected[: n - least + 1], shortest, longest)
                order = order[: n - least + matches]
                out.append((found[order].view(np.int64), node, n, matches, float(expected.sum())))
                if sum(len(o[0]) for o in out[-64:]) > ROWS or len(out) >= 64:
                    yield _prefix_batch(out)
                    out = []
            if out:
                yield _prefix_batch(out)

    return texts.mapInArrow(run, PREFIX_SCHEMA)


def _prefix_batch(out: list[tuple]) -> pa.RecordBatch:
    sizes = [len(o[0]) for o in out]
    repeated = [np.repeat(np.array([o[i] for o in out]), sizes) for i in (2, 3, 4)]
    which = pa.array(np.repeat(np.arange(len(out)), sizes))
    places = np.concatenate([np.arange(size, dtype=np.int32) for size in sizes])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([o[0] for o in out])), pa.array([o[1] for o in out], pa.binary()).take(which),
         pa.array(places), pa.array(repeated[0], pa.int64()), pa.array(repeated[1], pa.int32()), pa.array(repeated[2], pa.float64())],
        ["shingle", "node", "place", "n", "matches", "typical"],
    )


LIVE = pa.schema([
    ("shingle", pa.int64()), ("node", pa.binary()), ("place", pa.int32()), ("n", pa.int64()), ("matches", pa.int32()),
    ("head", pa.binary()), ("head_place", pa.int32()), ("head_n", pa.int64()),
])


class _Runs:
    """Rows (shingle, node, place, n, matches) sorted by shingle, from batch to batch; of a run its head is carried on."""

    def __init__(self):
        self.head: pa.Table | None = None  # the first row of the last run
        self.node: np.ndarray | None = None  # the last node seen
        self.waiting = False  # whether the head is still to be written

    def shared(self, batch: pa.RecordBatch) -> pa.Table | None:
        """The distinct rows of runs of several nodes, each with its run's head."""
        carried = self.head is not None
        rows = pa.Table.from_batches([batch.select(["shingle", "node", "place", "n", "matches"])])
        rows = pa.concat_tables([self.head, rows]).combine_chunks() if carried else rows
        shingle, node = rows.column("shingle").to_numpy(), _node_numbers(rows.column("node"))
        again = np.zeros(len(shingle), bool)  # the same shingle as the row before
        again[1:] = shingle[1:] == shingle[:-1]
        before = np.roll(node, 1, 0)
        if carried and len(node) > 1:
            before[1] = self.node
        keep = np.flatnonzero(~(again & (node == before).all(1)))
        self.node, again = node[-1], again[keep]
        run = np.cumsum(~again) - 1
        starts = keep[np.flatnonzero(~again)]
        sizes = np.bincount(run)
        held = sizes.copy()
        held[0] += carried and not self.waiting  # a head that was written belongs to a run of several
        out = held[run] > 1
        out[0] &= not carried or self.waiting
        self.waiting = held[-1] == 1
        self.head = rows.slice(int(starts[-1]), 1)
        if not out.any():
            return None
        heads = rows.take(pa.array(starts[run[out]]))
        found = rows.take(pa.array(keep[out]))
        columns = [*found.columns, heads.column("node"), heads.column("place"), heads.column("n")]
        return pa.Table.from_arrays(columns, schema=LIVE)


def _node_numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Keys of sets as two numbers each."""
    array = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    fixed = array.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[2 * fixed.offset :][: 2 * len(fixed)].reshape(-1, 2)


def _shared_only(prefixes: DataFrame) -> DataFrame:
    """Prefix shingles of several nodes, each with its ``head``: the most typical node.

    The rows of a shingle arrive sorted and are streamed in arrays; of a run only its first row is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            found = runs.shared(batch) if batch.num_rows else None
            if found is not None:
                yield from found.to_batches(max_chunksize=ROWS)

    sorted_runs = prefixes.repartition("shingle").sortWithinPartitions("shingle", F.desc("typical"), "node")
    return sorted_runs.mapInArrow(run, "shingle long, node binary, place int, n long, matches int, head binary, head_place int, head_n long")


def _bitmap(spark: SparkSession, ids: DataFrame) -> np.ndarray:
    """A bit for each of ``ids`` by its hash."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    words = ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << BITMAP_BITS}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most one per word
        out[row.word] = row.bits
    return out


def _node_sets(spark: SparkSession, texts: DataFrame, wanted: DataFrame, ids: DataFrame, like: Similarity) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``; ``ids`` are their smallest ids.

    The bitmap passes every text of these ids, and some others, which the join on the node then drops.
    """
    bits = spark.sparkContext.broadcast(_bitmap(spark, ids))  # BITMAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = shingles.Hasher(), bits.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (known[place >> 6].view(np.uint64) >> (place & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            for start in range(0, len(some), 256):
                found = list(shingles.shingle_sets(some.column("text").slice(start, 256), like.width, hasher))
                found = [f for f in found if len(f)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shingles.set_key(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())],
                    ["node", "shingles"],
                )

    placed = texts.select("text", F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS)).alias("place"))
    sets = placed.mapInArrow(run, "node binary, shingles binary")
    return sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(spark: SparkSession, texts: DataFrame, sets: DataFrame, pairs: DataFrame, like: Similarity) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets are similar. Only sets of nodes in pairs are made and moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for row, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[row] = like.under * common >= like.over * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    with passing(spark):
        nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "pair-nodes")
        ids = sets.where(F.col("node").isNotNull()).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        found = settle(_node_sets(spark, texts, nodes, ids, like), "node-sets")
        left = found.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        right = found.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return settle(met.mapInArrow(run, "a binary, b binary"), "links", keep=True)


def _possible(like: Similarity, n_a: str, place_a: str, n_b: str, place_b: str) -> Column:
    """Whether two sets can be similar if the first shingle that they share stands at these places, or before."""
    a, b = F.col(n_a), F.col(n_b)
    sizes = (a * like.under >= b * like.over) & (b * like.under >= a * like.over)
    room = F.least(a - F.col(place_a), b - F.col(place_b))
    return sizes & (room * (like.over + like.under) >= (a + b) * like.over)


def _possible_groups(like: Similarity) -> Column:
    """Whether any members of two groups are ``_possible``, by the bounds of their sizes and of what is left of them."""
    sizes = (F.col("most_a") * like.under >= F.col("least_b") * like.over) & (F.col("most_b") * like.under >= F.col("least_a") * like.over)
    room = F.least("room_a", "room_b")
    return sizes & (room * (like.over + like.under) >= (F.col("least_a") + F.col("least_b")) * like.over)


def _possible_member(like: Similarity) -> Column:
    """The same for a node of one group and the bounds of another; exact where that one is a single node."""
    n = F.col("n_a")
    sizes = (n * like.under >= F.col("least_b") * like.over) & (F.col("most_b") * like.under >= n * like.over)
    room = F.least(n - F.col("place_a"), F.col("room_b"))
    return sizes & (room * (like.over + like.under) >= (n + F.col("least_b")) * like.over)


def _with_heads(live: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of a prefix shingle's most typical node and another one that has it; they serve to form groups early."""
    met = live.where((F.col("head") != F.col("node")) & _possible(like, "n", "place", "head_n", "head_place"))
    return met.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()


def _across(live: DataFrame, roots: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of nodes in different groups that share as many prefix shingles as the less demanding asks for.

    What stands before the first prefix shingle that two nodes share (rarest first) is in no common set: it is rarer,
    so it would be in both prefixes. The places of the first one therefore bound what the two have in common, and the
    places of any later one bound it lower still: a pair that cannot be similar passes at no shingle, and is not made.
    """
    n, least = F.col("n"), like.least(F.col("n"))
    grouped = live.where(F.col("place") <= n - least).join(roots, "node", "left")
    grouped = grouped.select("shingle", "node", "place", "n", F.coalesce("root", "node").alias("root"))
    grouped = settle(grouped, "prefix-groups")
    mixed = grouped.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    open_ = grouped.join(mixed.where(F.col("low") != F.col("high")).select("shingle"), "shingle")
    open_ = settle(open_, "open-shingles")
    fields = ("node", "place", "n", "root")
    one = open_.select("shingle", *[F.col(c).alias(f"{c}_a") for c in fields])
    two = open_.select("shingle", *[F.col(c).alias(f"{c}_b") for c in fields])
    # First groups, then members: rows of one group are not compared with each other.
    held = open_.groupBy("shingle", "root").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("room")
    )
    held = settle(held, "open-groups")
    a, b = (held.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in held.columns[1:]]) for side in ("a", "b"))
    apart = a.join(b, "shingle").where((F.col("root_a") < F.col("root_b")) & _possible_groups(like))
    apart = settle(apart.select("shingle", "root_a", "root_b", "least_b", "most_b", "room_b"), "group-pairs")
    met = apart.join(one, ["shingle", "root_a"]).where(_possible_member(like)).join(two, ["shingle", "root_b"])
    met = met.where(_possible(like, "n_a", "place_a", "n_b", "place_b"))
    met = settle(met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "met")

    own = live.groupBy("node").agg(F.collect_list("shingle").alias("shared"), F.first("matches").alias("matches"))
    own = settle(own, "shared")  # of a node at most its prefix
    for side in ("a", "b"):
        met = met.join(own.select(*[F.col(c).alias(f"{c}_{side}") for c in own.columns]), F.col(side) == F.col(f"node_{side}"))
    several = F.size(F.array_intersect("shared_a", "shared_b")) >= F.least("matches_a", "matches_b")
    return met.where(several).select("a", "b")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold texts or sets go to Python a few at a time while the jobs within run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def groups(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """Per row of ``docs`` (doc_id, text): doc_id, ``n_shingles`` and ``component_id``, the smallest id of its group."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    with _small_batches(spark), passing(spark):
        rows = settle(_sets(texts, like), "shingle-sets", keep=True)
        sets = rows.where(F.col("part").isNull()).select("id", "n", "node")

        live = settle(_shared_only(_prefixes(spark, texts, _sketch(rows), like)), "prefixes")
        pairs = settle(_with_heads(live, like), "head-pairs")
        links = _verified(spark, texts, sets, pairs, like)
        pairs = settle(_across(live, components(links), like), "pairs")
        roots = components(links.union(_verified(spark, texts, sets, pairs, like)))

        # Copies become one row a node before nodes meet their group.
        nodes = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
        nodes = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
        nodes = settle(nodes, "nodes")
        least = settle(nodes.groupBy("root").agg(F.min("id").alias("least")), "least")
        groups_ = settle(nodes.select("node", "root").join(least, "root").select("node", "least"), "groups", keep=True)

    return sets.join(groups_, "node", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def _key(docs: DataFrame) -> Column:
    """The id of a row; without one a number above usual ids, from all columns, so equal rows have the same."""
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    number = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{name}`") for name in hashed]), 2)
    return F.coalesce(F.col("doc_id").cast("long"), number + F.lit(1 << 62))


def keep_one(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:  # noqa: B008
    """``docs`` without near copies: of each group the row with the smallest id stays, once.

    Rows without an id come after all others, by a hash of their columns; rows equal in everything count as one.
    """
    rows = docs.select(F.struct("*").alias("row"), _key(docs).alias("kept_id"), "text")
    found = groups(rows.select(F.col("kept_id").alias("doc_id"), "text"), like)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    once = rows.withColumn("mark", F.xxhash64("text")).join(kept, "kept_id", "left_semi")
    return once.dropDuplicates(["kept_id", "mark"]).select("row.*")
