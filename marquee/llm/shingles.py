"""Word shingles of texts as 64-bit numbers, computed on Arrow's buffers.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered. A word's number is a polynomial of its bytes
modulo 2**64 (from running sums, so all words of a block come out at once), then mixed; a shingle's number combines
those of its words in order. Blocks bound the memory: a long text goes through in several, and the sum of a word that a
block's end cuts is carried into the next, so a word may be of any length too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18  # bytes that are worked on at once
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole number."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Tables of the polynomial; one per task."""

    def __init__(self):
        lowered = np.arange(256)
        lowered[65:91] += 32
        self.value = mixed(np.arange(1, 257, dtype=_U))[lowered]
        self.word = np.ones(256, bool)
        self.word[[32, 9, 10, 11, 12, 13]] = False
        self.up, self.down = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 2**64), BLOCK + 1)

    def _sums(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Polynomials, lengths and starts of the words in at most ``BLOCK`` bytes; no word crosses ``bounds``."""
        inside = self.word[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds] = False
        after[bounds[bounds > 0] - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        return (sums[last + 1] - sums[first]) * self.down[first], last - first + 1, first

    @staticmethod
    def _numbers(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mixed(sums + (lengths - 1).astype(_U))

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words in ``data``, at most ``BLOCK`` bytes, and how many each of the texts ending at ``ends`` has."""
        sums, lengths, first = self._sums(data, ends[ends < len(data)])
        return self._numbers(sums, lengths), np.diff(np.searchsorted(first, ends), prepend=0)

    def text_words(self, data: np.ndarray) -> np.ndarray:
        """Numbers of the words of one text of any length."""
        parts, none = [np.zeros(0, _U)], np.zeros(0, np.int64)
        cut: tuple[np.ndarray, np.ndarray] | None = None  # sum and length of the word that the block before has begun
        for start in range(0, len(data), BLOCK):
            block, end = data[start : start + BLOCK], start + BLOCK
            sums, lengths, _ = self._sums(block, none)
            if cut is not None and self.word[block[0]]:
                sums[:1] = cut[0] + sums[:1] * _U(pow(_BASE, int(cut[1][0]), 2**64))
                lengths[:1] += cut[1]
            elif cut is not None:
                parts.append(self._numbers(*cut))
            cut = None
            if end < len(data) and self.word[block[-1]]:
                cut, sums, lengths = (sums[-1:], lengths[-1:]), sums[:-1], lengths[:-1]
            parts.append(self._numbers(sums, lengths))
        return np.concatenate(parts)


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width`` words."""
    n = len(words) - width + 1
    out = np.zeros(n, _U)
    for at in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + words[at : at + n]
    return mixed(out + _U(width))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of a text's shingles; fewer words than ``width`` make one shingle, no words none."""
    return np.unique(_combined(words, min(width, len(words)))) if len(words) else words


def shingle_sets(texts: pa.Array, width: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """The set of every text of an Arrow string array, in order; null counts as empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        end = min(end, len(texts))
        block = data[offsets[at] : offsets[end]]
        if end == at + 1:
            yield shingle_set(hasher.text_words(block), width)
        else:
            numbers, counts = hasher.words(block, offsets[at + 1 : end + 1] - offsets[at])
            start = 0
            for n in counts:
                yield shingle_set(numbers[start : start + n], width)
                start += n
        at = end


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
