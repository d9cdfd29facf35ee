"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

A token sequence is the encoding of its bytes exactly when each adjacent pair is (the merges of the pair's bytes give
the pair back). So encoding needs no merge loop over the text: a nondeterministic transducer guesses where tokens end,
its states being (last token, bytes read since). Its subset construction is done on demand, one transition at a time,
and kept. A determinised state holds the guesses that are still alive with what each would emit; what all of them
agree on is emitted at once, so output follows the input by less than the longest token. The table of states, pairs and
pieces has a bound each and starts anew when that is reached.

A file of ranks is broadcast: it is a vocabulary, bounded and independent of the data. Texts stay in their rows, there
is no shuffle, and a lost task is repeated from its input. Very long texts are cut into pieces by an iterator.

Defined results: a null text encodes as an empty one; null ids decode to an empty text; ids outside of the vocabulary
fail; byte sequences that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import codecs
import gc
import itertools
import threading
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_HEADS = 450_000, 500_000, 500_000, 100_000
HEAD = 6  # bytes of a piece that are looked up at once
IDLE_S = 6.0  # seconds without encoding after which a worker drops its tables
ROWS = 256  # texts that are encoded before they are handed on
NEVER = 1 << 60  # the rank of what is no token
LONG_TEXT = 1 << 20  # characters; longer texts are cut up piece by piece
DECODE_IDS = 1 << 16  # ids decoded at once


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token -> id, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}


class State(dict):
    """A determinised state. ``part`` is what the longest guess has read since its last token; every other guess has
    read an end of it. ``alive`` has the guesses, longest first, as three entries each: how much of ``part`` is its own,
    its last token, and what it would emit.

    As a table, by byte: the next state, and what is emitted on the way there. Steps are made when first asked for.
    """

    __slots__ = ("alive", "part", "transducer")

    def __init__(self, transducer: Transducer, part: bytes, alive: tuple):
        self.transducer, self.part, self.alive = transducer, part, alive

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        machine, part, known = self.transducer, self.part + bytes((byte,)), self.alive
        live, ended, size = [], None, len(part)
        for i in range(0, len(known), 3):
            own, last, pending = known[i] + 1, known[i + 1], known[i + 2]
            read = part[size - own :]
            if read in machine.prefixes:
                live.append((own, last, pending))
            token = machine.ranks.get(read)
            if token is not None and machine.follows(last, token) and machine.follows(-1, token):
                ended = (0, token, (*pending, token))  # of all ways to end here only one is the encoding
        if ended:
            live.append(ended)
        first = live[0][2]
        agreed = len(first)
        for _, _, pending in live[1:]:
            while first[:agreed] != pending[:agreed]:
                agreed -= 1
        if agreed:
            live = [(own, last, pending[agreed:]) for own, last, pending in live]
        alive = tuple([entry for guess in live for entry in guess])
        step = (machine.state(part[size - live[0][0] :], alive), first[:agreed])
        self[byte] = step
        return step


class Transducer:
    """Encodes pieces of bytes."""

    def __init__(self, ranks: dict[bytes, int], tables: float = 1.0):
        self.most = [int(n * tables) + 1 for n in (MAX_STATES, MAX_PAIRS, MAX_PIECES, MAX_HEADS)]
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.heads: dict[bytes, tuple[State, list[int]]] = {}  # first bytes of a piece -> where they lead
        self._reset()

    def forget(self) -> None:
        for state in self.states.values():
            state.clear()  # no cycles are left
        self.states, self.heads = {}, {}

    def _reset(self) -> None:
        """Forget all states but the first: nothing read, nothing pending. A state in use lives on."""
        self.forget()
        self.start = self.state(b"", (0, -1, ()))

    def state(self, part: bytes, alive: tuple) -> State:
        found = self.states.get((part, alive))
        if found is None:
            if len(self.states) >= self.most[0]:
                self._reset()
            found = self.states[part, alive] = State(self, part, alive)
        return found

    def merged(self, piece: bytes) -> list[int]:
        """What the merges give, by rank; for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        costs = [rank(a + b, NEVER) for a, b in itertools.pairwise(parts)]
        while costs and (least := min(costs)) < NEVER:
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: at the start)."""
        key = (last + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most[1]:
                self.pairs.clear()
            before = self.tokens.get(last, b"")
            known = self.merged(before + self.tokens[token]) == ([last, token] if last >= 0 else [token])
            self.pairs[key] = known
        return known

    @staticmethod
    def _run(at: State, out: list[int], piece: bytes) -> tuple[State, list[int]]:
        for byte in piece:
            at, emitted = at[byte]
            if emitted:
                out += emitted
        return at, out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        head = piece[:HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self._run(self.start, [], head)
            if len(self.heads) >= self.most[3]:
                self.heads.clear()
            self.heads[head] = known
        at, out = self._run(known[0], known[1].copy(), piece[HEAD:])
        out += at.alive[-1]  # where a piece may end, the last guess has a whole token behind it
        return out


class Pieces(dict):
    """Piece of text -> its ids as 32-bit numbers; computed when first met. What was not used lately is forgotten."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.transducer.most[2]:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[int, Pieces] = {}  # of this worker
_REST: list[threading.Timer] = []  # will drop it
_GATE = threading.Lock()  # held while tasks come and go, and while tables are dropped
_USERS: set[object] = set()  # tasks under way


def _release() -> None:
    """Drop the tables of a worker that has gone on to other work, so that they don't add to its memory."""
    with _GATE:
        if _USERS:
            return
        for pieces in _LOADED.values():
            pieces.transducer.forget()
            pieces.clear()
            pieces.older = {}
        _LOADED.clear()


@contextmanager
def _at_work() -> Iterator[None]:
    """The time in which a task uses the tables: they stay, and Python's cycle collector rests.

    What the transducer keeps is no garbage, and walking it takes an eighth of the time. States that are forgotten lose
    their steps, so they are freed without it.
    """
    me = object()
    with _GATE:  # waits while tables are dropped
        while _REST:
            _REST.pop().cancel()
        _USERS.add(me)
        gc.disable()
    try:
        yield
    finally:
        with _GATE:
            _USERS.discard(me)
            if not _USERS:
                gc.enable()
                _REST.append(threading.Timer(IDLE_S, _release))
                _REST[-1].daemon = True
                _REST[-1].start()


def _pieces(lines: bytes, tables: float = 1.0) -> Pieces:
    key = hash((lines, tables))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(Transducer(read_ranks(lines), tables))
    return _LOADED[key]


def encode_text(text: str, pieces: Pieces, pattern: regex.Pattern) -> bytes:
    """The ids of a text as 32-bit numbers."""
    if len(text) <= LONG_TEXT:
        return b"".join(map(pieces.__getitem__, pattern.findall(text)))
    found, out = (m.group() for m in pattern.finditer(text)), []
    while part := list(itertools.islice(found, 1 << 16)):
        out.append(b"".join(map(pieces.__getitem__, part)))
    return b"".join(out)


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of batches, a few at a time."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _encoded(texts: pa.Array, pieces: Pieces, cut: regex.Pattern) -> pa.ListArray:
    out = [encode_text(text, pieces, cut) if text else b"" for text in (value.as_py() for value in texts)]
    ends = np.cumsum([0, *[len(ids) // 4 for ids in out]])
    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(out))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)


def encoder(spark: SparkSession, path: str, pattern: str):
    """A column function: text -> array of ids, by the ranks in the file ``path`` on the driver."""
    lines = _shared(spark, path)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _at_work():
            pieces, cut = _pieces(lines.value), regex.compile(pattern)
            for batch in _slices(batches):
                yield _encoded(batch, pieces, cut)

    return F.arrow_udf(encode, "array<int>")


class TokenTable:
    """Bytes of all tokens in one array, by id."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {rank: token for token, rank in ranks.items()}
        tokens = [by_id.get(rank) for rank in range(max(by_id) + 1)]
        self.lengths = np.array([-1 if token is None else len(token) for token in tokens])
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.data = np.frombuffer(b"".join(token or b"" for token in tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or self.lengths[ids].min() < 0):
            raise ValueError("ids must be numbers of the vocabulary")
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        return self.data[np.arange(total) + np.repeat(self.starts[ids] - ends + sizes, sizes)].tobytes()


def decode_ids(ids: np.ndarray, tokens: TokenTable) -> str:
    """Text of ids, block by block; a character may begin in one block and end in the next."""
    machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
    for start in range(0, len(ids), DECODE_IDS):
        out.append(machine.decode(tokens.bytes_of(ids[start : start + DECODE_IDS])))
    return "".join(out) + machine.decode(b"", final=True)


def _decoded(batch: pa.ListArray, tokens: TokenTable) -> pa.Array:
    ends, values = batch.offsets.to_numpy(), batch.values
    values = values.fill_null(-1).to_numpy(zero_copy_only=False)
    out = []
    for row in range(len(batch)):
        out.append(decode_ids(values[ends[row] : ends[row + 1]] if batch[row].is_valid else values[:0], tokens))
    return pa.array(out, pa.string())


def decoder(spark: SparkSession, path: str):
    """A column function: array of ids -> text."""
    lines = _shared(spark, path)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = TokenTable(read_ranks(lines.value))
        for batch in _slices(batches):
            yield _decoded(batch, tokens)

    return F.arrow_udf(decode, "string")


def round_trip(spark: SparkSession, path: str, pattern: str, tables: float = 1.0):
    """A column function: text -> struct of its ``ids`` and of what they decode to, ``text``; one worker does both.

    ``tables`` scales the bounds of the tables that a worker keeps: smaller ones take less memory and more time.
    """
    lines = _shared(spark, path)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with _at_work():
            pieces, cut = _pieces(lines.value, tables), regex.compile(pattern)
            tokens = TokenTable(pieces.transducer.ranks)
            for batch in _slices(batches):
                ids = _encoded(batch, pieces, cut)
                yield pa.StructArray.from_arrays([ids, _decoded(ids, tokens)], ["ids", "text"])

    return F.arrow_udf(both, "struct<ids:array<int>,text:string>")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids, joined by spaces."""
    return F.sha2(F.array_join(ids, " "), 256)
