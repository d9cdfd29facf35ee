"""Language-model scores of documents by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of all orders, from the whole history down to the
token alone, and a uniform share for what was never seen. How they are mixed depends on how often the history was seen:
histories fall into buckets by the longest part of them that was seen and the power of two of its count. The mixture
weights of each bucket are learned by expectation-maximisation on tokens whose documents were deleted from the counts.
For scoring, the deleted documents count as well.

Counts grow with the corpus, so they are nowhere gathered. Documents are put into blocks of bounded size, written
compressed. A block asks for the counts of its distinct n-grams: their 64-bit numbers are sorted, cut into ranges, and
every range is one row on its way to the task that adds up that range of all blocks. The answers are the counts in the order
of the question, so numbers travel once. An n-gram that every document holds is one number a block. Then block and
answers meet, and everything else happens in arrays. Words are told apart by 64-bit numbers (``shingles.Hasher``).

The driver sees sums and the weights, some numbers per bucket. EM runs over the grouped counts of all deleted tokens,
one aggregation by bucket a round. Texts longer than a block are cut between words; a piece brings along the numbers of
the words before it, and the sums of its pieces are a document's.

Defined results: a null or empty text is the end token alone; rows without an id are trained on; equal rows are
documents of their own; an empty table has no rows; without training documents every token has the uniform
probability of a vocabulary of one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import shingles
from marquee.operators.settle import settle

KEPT, DELETED, UNSEEN = 0, 1, 2  # what a document is for
BLOCK_BYTES = 4 << 20  # text of a block, and of a piece of a long text
RANGE_BYTES = 4 << 20  # text whose n-grams are added up in one range
POWERS = 64  # buckets of a level: powers of two of a count
ROUNDS, ENOUGH = 12, 1e-4  # of EM; nats a token that end it
TASK_BITS = 33  # numbers of a task below, the task above

_U = np.uint64
BEGIN, END = _U(0x6C62272E07BB0142), _U(0x62B821756295C58D)
_FACTOR = 0xD6E8FEB86659FD93
SPACE = re.compile(rb"[\x20\x09-\x0D]")

BLOCK_SCHEMA = "block long, role int, bytes long, text binary, ends binary, first binary, last binary, lead binary, serials binary"
ASKED_SCHEMA = "range int, block long, role int, n_order int, n long, numbers binary, counts binary"
COUNTED_SCHEMA = "block long, range int, n_order int, n long, total binary, kept binary, tokens long, tokens_kept long, words long, words_kept long"
SCORED_SCHEMA = "serial long, role int, n_tokens long, n_known long, base_score double, score double"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _planes(numbers: np.ndarray) -> bytes:
    """Sorted numbers, byte by byte from the lowest: the high bytes hardly change and take no room."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _numbers_of(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


# --- blocks -----------------------------------------------------------------------------------


def _pieces(raw: bytes, order: int, hasher: shingles.Hasher) -> Iterator[tuple[bytes, bool, bool, list]]:
    """A text's pieces: bytes, whether the first and the last, and the numbers of the ``order`` - 1 tokens before."""
    start, lead = 0, [BEGIN] * (order - 1)
    while True:
        found = SPACE.search(raw, start + BLOCK_BYTES) if len(raw) - start > BLOCK_BYTES else None
        cut = found.start() if found else len(raw)
        piece = raw[start:cut]
        yield piece, start == 0, cut == len(raw), lead
        if cut == len(raw):
            return
        tail = piece.rsplit(None, order - 1)[-(order - 1) :] if order > 1 else []
        lead = (lead + [hasher.text_words(np.frombuffer(word, np.uint8))[0] for word in tail])[len(tail) :]
        start = cut


class _Block:
    def __init__(self, number: int, role: int):
        self.number, self.role, self.bytes = number, role, 0
        self.pieces: list[tuple] = []

    def add(self, *piece) -> None:
        self.pieces.append(piece)
        self.bytes += len(piece[0])

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        text, first, last, lead, serials, ids = zip(*self.pieces, strict=True)
        values = (
            self.number, self.role, self.bytes, pa.compress(b"".join(text), codec="zstd", asbytes=True),
            np.cumsum([len(t) for t in text], dtype=np.int64).tobytes(), np.array(first, np.uint8).tobytes(),
            np.array(last, np.uint8).tobytes(), np.array(lead, _U).tobytes(), np.array(serials, np.int64).tobytes(),
        )
        return _batch(BLOCK_SCHEMA, [values]).append_column("ids", pa.array([ids], pa.list_(kind)))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = _arrow(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _blocked(docs: DataFrame, order: int) -> DataFrame:
    """``docs`` (doc_id, text, role) as blocks of documents of one role. Every document gets a serial number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task = shingles.Hasher(), TaskContext.get().partitionId() << TASK_BITS
        open_blocks: dict[int, _Block] = {}
        serial = made = task
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts = batch.column("text").cast(pa.binary())
            for doc_id, raw, role in zip(batch.column("doc_id"), texts, batch.column("role"), strict=True):
                doc_id, role = doc_id.as_py(), role.as_py()
                for piece in _pieces(raw.as_py() or b"", order, hasher):
                    if role not in open_blocks:
                        open_blocks[role] = _Block(made, role)
                        made += 1
                    open_blocks[role].add(*piece, serial, doc_id)
                    if open_blocks[role].bytes >= BLOCK_BYTES:
                        yield open_blocks.pop(role).row(kind)
                serial += 1
        for block in open_blocks.values():
            yield block.row(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"{BLOCK_SCHEMA}, ids array<{kind}>")


class Grams:
    """The n-grams of a block, by position. ``scored`` are the positions of its tokens, each with its ``piece``."""

    def __init__(self, row: dict, order: int, hasher: shingles.Hasher):
        self.order, lead = order, order - 1
        ends = np.frombuffer(row["ends"], np.int64)
        first, last = np.frombuffer(row["first"], np.uint8), np.frombuffer(row["last"], np.uint8)
        text = np.frombuffer(pa.decompress(row["text"], row["bytes"], codec="zstd", asbytes=True), np.uint8)
        words, counts = _word_numbers(text, ends, hasher)
        sizes = lead + counts + last
        stops = np.cumsum(sizes)
        starts = stops - sizes
        sequence, kind = np.empty(int(stops[-1]), _U), np.zeros(int(stops[-1]), np.int8)
        if lead:
            at = starts[:, None] + np.arange(lead)
            sequence[at], kind[at] = np.frombuffer(row["lead"], _U).reshape(-1, lead), 1
        at = stops[last == 1] - 1
        sequence[at], kind[at] = END, 2
        sequence[kind == 0] = words
        self.scored = np.flatnonzero(kind != 1)
        self.piece = np.repeat(np.arange(len(sizes)), sizes - lead)
        before = starts + lead - 1  # the last token before a piece, the context of its first
        self.asked, self.unique, self.inverse, self.times = [], [], [], []
        rolled = sequence.copy()
        for n in range(1, order + 1):
            if n > 1:
                rolled[n - 1 :] += sequence[: len(sequence) - n + 1] * _U(pow(_FACTOR, n - 1, 2**64))
            counted = np.zeros(len(sequence), np.int64)
            counted[self.scored] = 1
            asked = kind != 1
            if n < order:
                asked[before], counted[before] = True, first  # what begins a document counts once with it
            asked = np.flatnonzero(asked)
            unique, inverse = np.unique(shingles.mixed(rolled[asked] + _U(n)), return_inverse=True)
            self.asked.append(asked)
            self.unique.append(unique)
            self.inverse.append(inverse)
            self.times.append(np.bincount(inverse, counted[asked], len(unique)).astype(np.uint32))
        self.length = len(sequence)

    def counts(self, answers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each order the count of every scored n-gram and of its history, from the counts of the unique ones."""
        found, earlier = [], None
        for asked, inverse, answer in zip(self.asked, self.inverse, answers, strict=True):
            here = np.zeros(self.length, np.int64)
            here[asked] = answer[inverse]
            found.append((here[self.scored], None if earlier is None else earlier[self.scored - 1]))
            earlier = here
        return found


def begin_number(order: int) -> np.uint64:
    """The number of the unigram that stands for the beginning; it is no token."""
    return shingles.mixed(np.array([BEGIN + _U(1)]))[0] if order > 1 else None


def _word_numbers(data: np.ndarray, ends: np.ndarray, hasher: shingles.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all pieces, and how many each has."""
    numbers, counts, at, begin = [np.zeros(0, _U)], [], 0, 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, begin + shingles.BLOCK, "right")))
        if upto == at + 1:
            numbers.append(hasher.text_words(data[begin : ends[at]]))
            counts.append(np.array([len(numbers[-1])]))
        else:
            found = hasher.words(data[begin : ends[upto - 1]], ends[at:upto] - begin)
            numbers.append(found[0])
            counts.append(found[1])
        at, begin = upto, int(ends[upto - 1])
    return np.concatenate(numbers), np.concatenate(counts)


# --- counts -----------------------------------------------------------------------------------


def _asked(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """Every block's n-grams, a row for each order and range of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.Hasher()
        for batch in batches:
            for row in _rows(batch):
                grams = Grams(row, order, hasher)
                for n in range(order):
                    numbers, times, out = grams.unique[n], grams.times[n], []
                    place = ((numbers >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(place, prepend=-1, append=ranges))
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                        counts = None if row["role"] == UNSEEN else _packed(times[a:b])
                        out.append((int(place[a]), row["block"], row["role"], n + 1, b - a, _planes(numbers[a:b]), counts))
                    yield _batch(ASKED_SCHEMA, out)

    return blocks.mapInArrow(run, ASKED_SCHEMA)


def _rows(table) -> Iterator[dict]:
    """Rows of an Arrow batch or table, one at a time."""
    for at in range(table.num_rows):
        yield {name: table.column(name)[at].as_py() for name in table.schema.names}


def _counted(asked: DataFrame, order: int) -> DataFrame:
    """For every row of ``asked`` the counts of its n-grams over all blocks; a row without a block has a range's sums."""
    begin = begin_number(order)

    def run(table: pa.Table) -> pa.Table:
        rows, out = sorted(_rows(table), key=lambda r: (r["n_order"], r["block"])), []
        for n in range(1, order + 1):
            mine = [r for r in rows if r["n_order"] == n]
            if not mine:
                continue
            numbers, inverse = np.unique(np.concatenate([_numbers_of(r["numbers"], r["n"]) for r in mine]), return_inverse=True)
            kept, total, at = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64), 0
            for r in mine:
                if r["role"] != UNSEEN:
                    where, times = inverse[at : at + r["n"]], _unpacked(r["counts"], r["n"], np.uint32)
                    total[where] += times
                    if r["role"] == KEPT:
                        kept[where] += times
                at += r["n"]
            at = 0
            for r in mine:
                where = inverse[at : at + r["n"]]
                known = _packed(kept[where]) if r["role"] == DELETED else None
                out.append((r["block"], r["range"], n, r["n"], _packed(total[where]), known, 0, 0, 0, 0))
                at += r["n"]
            if n == 1:
                token = np.ones(len(numbers), bool) if begin is None else numbers != begin
                sums = [int(c[token].sum()) for c in (total, kept)] + [int((c[token] > 0).sum()) for c in (total, kept)]
                out.append((None, rows[0]["range"], 1, 0, b"", None, *sums))
        return pa.Table.from_batches([_batch(COUNTED_SCHEMA, out)])

    return asked.groupBy("range").applyInArrow(run, COUNTED_SCHEMA)


def _answers(counted: pa.Table, name: str, order: int) -> list[np.ndarray]:
    found: list[list] = [[] for _ in range(order)]
    for row in sorted(_rows(counted.select(["range", "n_order", "n", name])), key=lambda r: r["range"]):
        found[row["n_order"] - 1].append(_unpacked(row[name], row["n"], np.int64))
    return [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in found]


# --- mixture ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Sizes of the training text and the mixture weights: a row per level and power, the uniform share first."""

    order: int
    tokens: int
    words: int
    weights: np.ndarray

    def estimates(self, counts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The bucket of every token, and its estimates of all orders, the uniform one first."""
        return _estimates(counts, self.tokens, self.words)

    def log10(self, counts: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        bucket, shares = self.estimates(counts)
        return np.log10(sum(self.weights[bucket, j] * share for j, share in enumerate(shares)))


def _estimates(counts, tokens: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n = len(counts[0][0])
    shares, bucket = [np.full(n, 1.0 / (words + 1))], np.zeros(n, np.int64)
    for level, (here, history) in enumerate(counts):
        history = np.full(n, tokens) if history is None else history
        seen = history > 0
        shares.append(np.where(seen, here / np.maximum(history, 1), 0.0))
        bucket = np.where(seen, level * POWERS + np.frexp(history.astype(float))[1] - 1, bucket)
    return bucket, shares


def _held(blocks: DataFrame, counted: DataFrame, order: int) -> DataFrame:
    """Counts of deleted tokens and their histories among the kept documents, and how many tokens have them alike."""
    names = [f"c{n}" for n in range(1, order + 1)] + [f"h{n}" for n in range(2, order + 1)]
    schema = ", ".join(f"{name} long" for name in [*names, "held"])

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(next(_rows(block)), order, shingles.Hasher())
        counts = grams.counts(_answers(answers, "kept", order))
        columns = [here for here, _ in counts] + [history for _, history in counts[1:]]
        key = np.zeros(len(columns[0]), _U)
        for column in columns:
            key = shingles.mixed(key * _U(_FACTOR) + column.astype(_U))
        _, where, held = np.unique(key, return_index=True, return_counts=True)
        return pa.table([*[column[where] for column in columns], held], names=[*names, "held"])

    mine = blocks.where(F.col("role") == DELETED).groupBy("block")
    rows = mine.cogroup(counted.where(F.col("kept").isNotNull()).groupBy("block")).applyInArrow(run, schema)
    return rows.groupBy(*names).agg(F.sum("held").alias("held"))


def _learned(held: DataFrame, order: int, tokens: int, words: int) -> np.ndarray:
    """Mixture weights of all buckets, by EM on ``held`` with the sizes of the kept text; each share gets one token more.

    A bucket without deleted tokens takes the weights of the next lower one of its level, else of the next higher.
    """
    spark, names = held.sparkSession, [f"w{j}" for j in range(order + 1)]
    bucket, shares = F.lit(max(tokens, 1).bit_length() - 1), [F.lit(1.0 / (words + 1))]
    shares.append(F.col("c1") / F.lit(float(max(tokens, 1))))
    for n in range(2, order + 1):
        history = F.col(f"h{n}")
        shares.append(F.when(history > 0, F.col(f"c{n}") / history).otherwise(0.0))
        power = F.length(F.bin(history)) - 1
        bucket = F.when(history > 0, (n - 1) * POWERS + power).otherwise(bucket)
    rows = held.select(bucket.cast("int").alias("bucket"), "held", *[s.alias(f"f{j}") for j, s in enumerate(shares)])
    rows = settle(rows, "lm-held")
    weights = {row["bucket"]: None for row in rows.select("bucket").distinct().collect()}  # POWERS a level at most
    for key in weights:
        known = 2 + key // POWERS
        weights[key] = [1.0 / known if j < known else 0.0 for j in range(order + 1)]
    before = None
    for _ in range(ROUNDS if weights else 0):
        given = pa.table([list(weights), *map(list, zip(*weights.values(), strict=True))], names=["bucket", *names])
        given = spark.createDataFrame(given).withColumn("bucket", F.col("bucket").cast("int"))
        parts = [F.col(f"f{j}") * F.col(f"w{j}") for j in range(order + 1)]
        mixed = sum(parts[1:], parts[0])
        sums = rows.join(F.broadcast(given), "bucket").groupBy("bucket").agg(
            *[F.sum(F.col("held") * part / mixed).alias(name) for part, name in zip(parts, names, strict=True)],
            F.sum("held").alias("held"), F.sum(F.col("held") * F.log(mixed)).alias("fit"),
        ).collect()
        for row in sums:
            known = 2 + row["bucket"] // POWERS
            weights[row["bucket"]] = [(row[name] + 1) / (row["held"] + known) if j < known else 0.0 for j, name in enumerate(names)]
        fit = math.fsum(row["fit"] for row in sums) / sum(row["held"] for row in sums)
        if before is not None and fit - before < ENOUGH:
            break
        before = fit
    return _spread(weights, order)


def _spread(weights: dict[int, list[float]], order: int) -> np.ndarray:
    out = np.zeros((order * POWERS, order + 1))
    for level in range(order):
        known = [key for key in sorted(weights) if key // POWERS == level]
        for key in range(level * POWERS, (level + 1) * POWERS):
            lower, higher = [k for k in known if k <= key], [k for k in known if k > key]
            found = weights[lower[-1]] if lower else weights[higher[0]] if higher else None
            out[key] = found or [1.0 / (level + 2) if j < level + 2 else 0.0 for j in range(order + 1)]
    return out


# --- scores -----------------------------------------------------------------------------------


def _scored(blocks: DataFrame, counted: DataFrame, model: Model) -> DataFrame:
    """Every piece's document, and the sums over its tokens."""
    order = model.order

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(block))
        grams = Grams(row, order, shingles.Hasher())
        counts = grams.counts(_answers(answers, "total", order))
        serials = np.frombuffer(row["serials"], np.int64)
        here, size = counts[0][0], len(serials)
        # Without training text all tokens are alike: probability one.
        score = model.log10(counts) if model.tokens else np.zeros(len(here))
        base = np.log10((here + 1) / (model.tokens + 1 * (model.words + 1)))
        columns = [
            serials, np.full(size, row["role"]), np.bincount(grams.piece, minlength=size),
            np.bincount(grams.piece, here > 0, size).astype(np.int64), np.bincount(grams.piece, base, size),
            np.bincount(grams.piece, score, size),
        ]
        kinds = _arrow(SCORED_SCHEMA)
        out = pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
        return out.append_column("doc_id", pa.array(row["ids"], block.schema.field("ids").type.value_type))

    answers = counted.where(F.col("block").isNotNull()).select("block", "range", "n_order", "n", "total")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    pairs = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return pairs.applyInArrow(run, f"{SCORED_SCHEMA}, doc_id {kind}")


def remainder(doc_id: Column, modulus: int = 7) -> Column:
    """CRC-32 of an id as text modulo ``modulus``; -1 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus, F.lit(-1))


def score(docs: DataFrame, held_out: Column, deleted: Column, doc_id: str = "doc_id", order: int = 2) -> DataFrame:
    """Every row's id, ``held_out``, n_tokens, n_known, train_tokens, base_score and score, both log10 of probabilities.

    The model learns from rows that are not ``held_out``; of those, the ``deleted`` ones fit the mixture weights.
    ``base_score`` is that of the tokens alone, with one added to every count.
    """
    role = F.when(F.coalesce(held_out, F.lit(False)), UNSEEN).when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(KEPT)
    blocks = settle(_blocked(docs.select(F.col(doc_id).alias("doc_id"), "text", role.alias("role")), order), "lm-blocks")
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    counted = settle(_counted(_asked(blocks, order, max(1, math.ceil(size / RANGE_BYTES))), order), "lm-counts")
    sums = counted.where(F.col("block").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "tokens_kept", "words_kept")])
    tokens, words, tokens_kept, words_kept = sums.first()
    weights = _learned(_held(blocks, counted, order), order, tokens_kept, words_kept)
    pieces = _scored(blocks, counted, Model(order, tokens, words, weights))
    sums = [F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base_score", "score")]
    found = pieces.groupBy("serial").agg(F.first("doc_id").alias(doc_id), F.first("role").alias("role"), *sums)
    return found.select(
        doc_id, (F.col("role") == UNSEEN).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast(T.LongType()).alias("train_tokens"), "base_score", "score",
    )
