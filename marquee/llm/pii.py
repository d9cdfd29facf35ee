"""Personal data: certain patterns, and candidates that boosted trees accept.

The base patterns (email, ip, card, phone) are always spans. Besides them, loose generators propose overlapping spans:
addresses spelled out, numbers in any grouping, long ip addresses. Boosted trees score each proposal from its format
(digits, groups, separators, checksum) and its context (words and characters around it); proposals above their kind's
threshold become spans, best first, where they overlap no other span.

The trees learn from every document (``learn``). Its base spans are positive examples. A corpus proposal that is no base
span may be personal data or not, so it is no example; only what stands around it is used. The other examples need no
personal data in the text and are always made: scenes of one to four invented spans, rewritten base spans and decoys, in
contexts of the document, where what was put in is positive and every other proposal, also one that cuts or joins, is
negative. Contexts are those of every base span, of every run of overlapping proposals, and of a place in every
``STRETCH`` characters of text; where a table has fewer than ``SCENES`` documents, several scenes are made in each, and
what is made follows from the text alone. Examples stay in Spark, in blocks of binned rows; a level of a tree is grown
from sums over all of them, a few thousand whole numbers per task, so trees do not depend on how rows lie in tasks. A
kind's threshold is the lowest sum of the trees at which the share of wrong spans among its held-out made negatives is
within ``WRONG`` and the score, calibrated on held-out examples by pooling adjacent violators, is at least ``LEAST``; for
both, sums are counted in steps of 1 / ``FINE``.

Every pattern is linear in the text: runs are matched possessively, loose patterns have bounded parts, and from each
digit group at most ``MOST`` windows begin. Proposals are made one by one, scored ``BLOCK`` at a time, and what is kept
of a text waits only until its last one is scored. Texts stay in their rows; nothing is shuffled. Defined results: null is
an empty text; offsets are code points, the end exclusive; trees of an empty table know spans without anything around.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import packed, unpacked
from marquee.operators.settle import passing, settle

CONTEXT = 32  # characters around a span
STRETCH = 8192  # characters of a text, in each of which a scene is made
WRONG, LEAST = 0.002, 0.9
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 16
SCENES = 8000  # that are made at least, besides those of base spans
BLOCK = 8192  # proposals that are described at once, and examples of a block at least
KEPT = 4  # trees after which the sums of the examples are written
FINE, FAR = 1024, 64  # steps of a sum that are told apart, and the largest sum
UNIT = 2**20  # slopes and weights are summed as whole numbers of this part, so that no order of rows changes them

# The kinds in the order of the results, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Loose patterns.
SPELLED = re.compile(r"[(\[](?:at|AT|arobase)[)\]]\s?")
BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[](?:dot|DOT|point)[)\]]\s?)[A-Za-z0-9-]{1,63}){1,6}")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9])++")
GROUP = re.compile(r"[0-9]++")
MOST = 19  # digits of a number
LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f:]{2,}+")
HINTS = {
    "email": re.compile(r"(?i)mail|contact|contacto|kontakt|schreib|écri|escrib"),
    "ip": re.compile(r"(?i)\bip\b|server|host|addr|login|serveur|servidor"),
    "card": re.compile(r"(?i)card|visa|credit|karte|carte|tarjeta|amex|payment"),
    "phone": re.compile(r"(?i)tel|phone|call|fax|mobil|cell|ruf|appel|llam"),
}
ELSE = {kind: re.compile("|".join(h.pattern.replace("(?i)", "") for k, h in HINTS.items() if k != kind), re.I) for kind in HINTS}
OTHER = re.compile(r"(?i)version|license|isbn|order|invoice|token|password|secret|key|id\b|page|date|total|no\.")


DOUBLED = {str(i): 2 * i - 9 * (i > 4) for i in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(map(DOUBLED.__getitem__, digits[-2::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(GROUP.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the certain patterns, by kind and start."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append(("email", start, free))
        else:
            free = max(free, at + 1)  # a local part cannot reach across an @
        at = text.find("@", max(at + 1, free))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_small(part) for part in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255; it may have leading zeros."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of everything that might be personal data; spans may overlap, one text may have two kinds.

    Numbers are all windows of a run's digit groups, however long the run, so what stands beside a number hides it not.
    """
    end = 0
    for m in SPELLED.finditer(text):
        start = m.start() - (m.start() > end and text[m.start() - 1].isspace())
        end = m.end()
        before, after = BEFORE_AT.search(text[max(0, start - 64) : start]), AFTER_AT.match(text, end)
        if before and after:
            yield "email", start - len(before.group()), after.end()
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            yield from _windows(text, (g.span() for g in GROUP.finditer(text, *m.span())))
    if text.count(":") >= 2:
        for m in LONG_IP.finditer(text):
            if span := _long_ip(text, *m.span()):
                yield "ip", *span


def _windows(text: str, groups: Iterator[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Every run of consecutive digit groups that has as many digits as a kind; at most ``MOST`` from each start."""
    ahead = deque(islice(groups, MOST))  # more groups have more digits
    while ahead:
        start, n = ahead[0][0], 0
        start -= start > 0 and text[start - 1] in "+("
        for j, (first, end) in enumerate(ahead):
            n += end - first
            if n > MOST:
                break
            if 7 <= n <= 15:
                yield "phone", start, end
            if 13 <= n:
                yield "card", start, end
            if j == 3 and end - start >= 7 and text.count(".", start, end) == 3:
                yield "ip", start, end
        ahead.popleft()
        ahead.extend(islice(groups, 1))


def _long_ip(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Where in a run of hexadecimal digits and colons a long address is: up to eight groups, one '::' for zeros."""
    if start and text[start - 1].isalnum():  # the run begins within a word, as after "ip:"
        start = text.find(":", start, end)
        if start < 0 or text[start : start + 2] == "::":
            return None
    start += text[start] == ":" and text[start : start + 2] != "::"
    end -= end > start and text[end - 1] == ":" and text[max(start, end - 2) : end] != "::"
    if not 2 < end - start <= 39 or (end < len(text) and text[end].isalnum()):
        return None
    parts = text[start:end].split("::")
    groups = [g for part in parts if part for g in part.split(":")]
    whole = len(parts) == 1 and 4 <= len(groups) <= 8
    if (whole or (len(parts) == 2 and 1 <= len(groups) <= 7)) and all(0 < len(g) <= 4 for g in groups):
        return start, end
    return None


FEATURES = 37
# Sizes of groups that numbers are often written in; the likelier ones of a whole number first.
SHAPES = {
    "email": (), "ip": ((4,) * 8, (2,) * 6), "card": ((4, 4, 4, 4), (16,), (4, 6, 5), (15,)),
    "phone": ((3, 3, 4), (2, 2, 2, 2, 2), (10,), (1, 3, 3, 4), (3, 3, 3), (3, 7), (4, 6), (5, 5), (4, 7)),
}
NUMERIC = "0123456789 ()./-"
RUNS, DATE, PARTING = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"(?:19|20)[0-9]{2}(?![0-9])|[0-3]?[0-9][/.][01]?[0-9][/.]"), re.compile(r"[^A-Za-z0-9-]+")
LEFT, RIGHT = re.compile(r"([0-9]+)[ ()./-]{0,2}\Z"), re.compile(r"[ ()./-]{0,2}([0-9]+)")  # groups beside a span


def described(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format and context of a proposal, as numbers."""
    digits, groups = "".join(GROUP.findall(span)), RUNS.findall(span)
    sizes = [len(g) for g in groups] or [0]
    largest = max([int(g) if len(g) < 5 else 99999 for g in GROUP.findall(span)], default=0)
    shape, usual = tuple(sizes), SHAPES[kind]
    left, right, ending = LEFT.search(before), RIGHT.match(after), PARTING.split(span)[-1]
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        span.count(" "), span.count("-"), span.count("."), span.count("/"), span.count("(") - 2 * span.count(")"),
        span.count(":"), luhn(digits) if kind == "card" else -1, int(digits[0]) if digits else -1, len(set(digits)),
        bool(DATE.match(span)),
        bool(HINTS[kind].search(before)), bool(OTHER.search(before)),
        bool(ELSE[kind].search(before)),
        ord(before[-1]) if before and before[-1] < "\x80" and not before[-1].isalpha() else (0 if not before else 127),
        ord(after[0]) if after and after[0] < "\x80" and not after[0].isalpha() else (0 if not after else 127),
        sum(map(str.isdigit, before[-8:] + after[:8])), largest,
        len(left.group(1)) if left else 0, len(right.group(1)) if right else 0, int(digits[1]) if len(digits) > 1 else -1,
        len(set(sizes)), len(ending), ending.isalpha() + ending.islower(), span.count("::"),
        sum(map(str.isdigit, before[len(before.rstrip(NUMERIC)) :])), sum(map(str.isdigit, after[: len(after) - len(after.lstrip(NUMERIC))])),
        after.lstrip(" ")[:1] == "(", span.count("(") == span.count(")"), len(usual) - usual.index(shape) if shape in usual else 0,
    ]


def _number(rnd: random.Random, size: int, first: str = "0123456789") -> str:
    return rnd.choice(first) + "".join(rnd.choices("0123456789", k=size - 1))


def _word(rnd: random.Random, least: int, most: int) -> str:
    return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(least, most)))


def invented(kind: str, rnd: random.Random) -> str:
    """A span of the base pattern, or for card and phone also one that it leaves out."""
    if kind == "email":
        name = _word(rnd, 2, 9) + rnd.choice(["", "." + _word(rnd, 2, 9), "_" + _word(rnd, 1, 6), str(rnd.randint(1, 99))])
        host = _word(rnd, 2, 10) + rnd.choice(["", "", str(rnd.randint(1, 9)), "." + _word(rnd, 2, 8), "-" + _word(rnd, 2, 8)])
        return f"{name}@{host}.{rnd.choice('com com org net de fr es info edu io eu co.uk'.split())}"
    if kind == "ip":
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    if kind == "card":
        start, size = rnd.choice([("4", 16), ("4", 16), ("5", 16), ("2", 16), ("6", 16), ("34", 15), ("37", 15)])
        body = start + "".join(rnd.choices("0123456789", k=size - 1 - len(start)))
        return next(body + c for c in "0123456789" if luhn(body + c))
    return f"+{rnd.choice(['1', '33', '34', '44', '49'])}{_number(rnd, 9, '123456789')}{rnd.choice(['', '0', '7'])}"


def rewritten(kind: str, span: str, rnd: random.Random) -> str:
    """Another way to write the same thing, which the base pattern does not match where it stands alone."""
    digits = _digits(span)
    if kind == "email":
        name, _, host = span.partition("@")
        at = rnd.choice([" (at) ", "[at]", " [at] ", "(at)", " (AT) ", " [AT] ", "(arobase)"])
        return f"{name}{at}{host.replace('.', rnd.choice(['.', ' (dot) ', '[dot]', '(dot)', ' [DOT] ', ' (point) ']))}"
    if kind == "ip":
        groups = [f"{rnd.randrange(1 << rnd.choice([4, 8, 16, 16])):x}" for _ in range(8)]
        groups[0] = rnd.choice(["2001", "2001", "2a02", "fe80", "fd" + groups[1][:2].rjust(2, "0"), groups[0]])
        if rnd.random() < 0.4:
            return ":".join(groups)
        return ":".join(groups[: rnd.randint(1, 4)]) + "::" + ":".join(groups[rnd.randint(4, 7) :])
    if kind == "card":
        size = (4, 6, 5) if len(digits) == 15 else (4,) * (len(digits) // 4) + (len(digits) % 4,) * (len(digits) % 4 > 0)
        ends = np.cumsum(size)
        return rnd.choice([".", "  ", "/"]).join(digits[e - n : e] for e, n in zip(ends, size, strict=True))
    return _national(rnd, digits)


def _national(rnd: random.Random, digits: str) -> str:
    """A phone number without '+': with its country after 00, or as it is written at home."""
    digits = digits.rjust(10, "5")
    local, gap = rnd.choice("23456789") + digits[-9:], rnd.choice("-. ")
    us = (f"({local[:3]}) {local[3:6]}{gap}{local[6:]}", gap.join((local[:3], local[3:6], local[6:])))
    pairs = "0" + rnd.choice("123456789") + local[2:]
    return rnd.choice([
        *us, *us, f"1{gap}{us[1]}", f"00{rnd.choice(['1', '33', '34', '44', '49'])} {gap.join((local[1:4], local[4:7], local[7:]))}",
        pairs, pairs, gap.join(pairs[i : i + 2] for i in range(0, 10, 2)), f"{pairs[:4]}{rnd.choice(' /-')}{pairs[4:]}",
        f"({pairs[:3]}) {pairs[3:]}", f"{pairs[:5]} {pairs[5:]}", f"{rnd.choice('6789')}{local[1:3]}{gap}{local[3:6]}{gap}{local[6:9]}",
    ])


def decoy(rnd: random.Random) -> str:
    """What looks like a span of some kind and is nobody's: dates, amounts, serials, failed checksums, times, file names."""
    a, b, c, d = (rnd.randint(1, 998) for _ in range(4))
    serial = _number(rnd, rnd.randint(13, 19))
    if luhn(serial):
        serial = serial[:-1] + str((int(serial[-1]) + 1) % 10)
    word, hexes = _word(rnd, 2, 8), [f"{rnd.randrange(256):02x}" for _ in range(8)]
    at, kind = rnd.choice([" (at) ", "[at]", " [at] ", "(at)", " (AT) "]), rnd.choice(["email", "email", "ip", "number", "number"])
    if kind == "email":
        return word + at + rnd.choice([
            f"{a % 24}.{b % 60:02}", f"{a}.{b}", f"{a}.{b}.{c}", f"{_word(rnd, 2, 8)}.{a}", f"{rnd.choice('eip')}.{rnd.choice('geh')}",
            f"{_word(rnd, 2, 8)}.{_word(rnd, 2, 8).title()}", f"v{a % 9}.{b % 9}", f"{_word(rnd, 1, 3)}.{rnd.choice('abcxyz')}", f"{a}.{_word(rnd, 1, 1)}{b}",
        ])
    if kind == "ip":
        return rnd.choice([
            f"{a}.{b}.{c + 256}.{d}", f"{a % 20}.{b % 20}.{c + 255}.{d % 20}", ":".join(hexes[:6]), ":".join(h.upper() for h in hexes[:6]), f"{a % 24:02}:{b % 60:02}:{c % 60:02}:{d:03}",
            f"{a % 9}:{b % 9}:{c % 9}:{d % 9}", f"20{a % 30:02}:{b % 12 + 1:02}:{c % 28 + 1:02}:{d % 24:02}:{a % 60:02}:{b % 60:02}",
            f"{rnd.choice('Bad Ada Face Abc Dead Cafe Fab a b C'.split())}::{rnd.choice('add Fade Dec bed Feed c d E'.split())}", f"{a}:{b}:{c}:{d}",
        ])
    return rnd.choice([
        f"20{a % 30:02}-{b % 12 + 1:02}-{c % 28 + 1:02}", f"20{a % 30:02}-{b % 12 + 1:02}-{c % 28 + 1:02} {d % 24:02}", f"{a % 28 + 1}/{b % 12 + 1}/20{c % 30:02} {d % 24}:{a % 60:02}",
        f"{a % 28 + 1:02}.{b % 12 + 1:02}.20{c % 30:02}", f"20{a % 30:02}{b % 12 + 1:02}{c % 28 + 1:02}", f"{a} {b:03} {c:03} {d:03}", f"{a}.{b:03}{c:03}{d}", f"{a}.{b:03}.{c:03}",
        serial, serial, f"{serial[:4]} {serial[4:8]} {serial[8:12]} {serial[12:]}", f"{a:05}{b:05}", f"{a:09}", f"{a:010}", f"20{a % 30:02}-20{b % 30:02}", _number(rnd, rnd.randint(7, 12), "123456789"),
        f"{''.join(hexes[:2])}a{serial[:9]}f{hexes[3]}", f"{hexes[0]}c{serial[:13]}", f"{serial[:10]}e{hexes[1]}", f"978-{a % 10}-{b:03}-{c:05}-{d % 10}", f"{a}.{b % 10} {c}.{d % 10} {b}.{a % 10} {d}.{c % 10}",
    ])


CUES = {"email": "mail contact", "ip": "ip server address", "card": "card visa credit", "phone": "tel phone call fax"}
OTHERS = "version order invoice isbn token id page date total".split()


def _scene(parts: list[tuple[str, str]], before: str, after: str, rnd: random.Random) -> list[tuple[str, str, str, str, bool]]:
    """Examples from ``parts``, (kind or nothing, text), written one after the other in a context."""
    before = before.rstrip("0123456789 ()[]./:+-") + rnd.choice(["", " ", " ", " ", " ", ": ", " (", "\n", ", "])
    after = rnd.choice(["", " ", " ", " ", ". ", ", ", ") ", "\n", "; "]) + after.lstrip("0123456789 ()[]./:+-")
    if rnd.random() < 0.3:
        kind = parts[0][0]
        before += f" {rnd.choice(CUES[kind].split() if kind else OTHERS)}{rnd.choice([' ', ': '])}"
    before = before if not before or not (before[-1].isalnum() or before[-1] in LOCAL) else before + " "
    text, truth = before, set()
    for at, (kind, span) in enumerate(parts):
        text += rnd.choice([" ", " ", "  ", ", ", " / ", "\n"]) if at else ""
        truth.add((kind, len(text), len(text) + len(span)))
        text += span
    end, text = len(text), text + (after if not after[:1].isalnum() else " " + after)
    certain = base_spans(text)
    return [
        (kind, *_around(text, s, e), (kind, s, e) in truth)
        for kind, s, e in proposals(text)
        if len(before) <= s and e <= end and not any(s < f and b < e for _, b, f in certain)
    ]


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, bin, value by node


@dataclass
class Trees:
    """Boosted trees on binned features, the calibration of their sums, and each kind's least sum."""

    edges: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    thresholds: dict[str, float] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            out += _values(tree, bins.T)
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        at, values = self.steps
        return values[np.clip(np.searchsorted(at, sums, "right") - 1, 0, len(values) - 1)] if len(at) else np.zeros(len(sums))


def _values(tree: Tree, bins: np.ndarray) -> np.ndarray:
    feature, cut, value = tree
    node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(DEPTH):
        node = 2 * node + 1 + (bins[feature[node], rows] > cut[node])
    return value[node]


@dataclass
class Block:
    """Different binned examples: bins by feature, kind, how many there are and how many are positive, sum."""

    bins: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def added(self, trees: Sequence[Tree]) -> np.ndarray:
        """The sums with those of further trees."""
        sums = self.sums
        for tree in trees:
            sums = sums + _values(tree, self.bins)
        return sums

    def slopes(self, trees: Sequence[Tree], tree: Tree, depth: int) -> np.ndarray:
        """Slopes and weights by node of a level of ``tree``, feature and bin, in whole ``UNIT``."""
        p = 1 / (1 + np.exp(-self.added(trees)))
        n, positive = self.counts
        slope = np.rint(p * UNIT) * n - positive * float(UNIT)
        weight = np.rint(p * (1 - p) * UNIT) * n
        feature, cut, _ = tree
        node, rows = np.zeros(len(p), np.int64), np.arange(len(p))
        for _ in range(depth):
            node = 2 * node + 1 + (self.bins[feature[node], rows] > cut[node])
        cell, cells = (node - (2**depth - 1)) * (BINS + 1), 2**depth * (BINS + 1)
        sums = [[np.bincount(at, v, cells).reshape(2**depth, -1) for v in (slope, weight)] for at in (cell + b for b in self.bins)]
        return np.array(sums).astype(np.int64).transpose(2, 0, 3, 1)  # node, feature, bin, which

    def steps(self, trees: Sequence[Tree]) -> np.ndarray:
        """Kind, step of the sum, examples, positives of them."""
        step = np.clip(np.floor(self.added(trees) * FINE), -FAR * FINE, FAR * FINE).astype(np.int64)
        at, where = np.unique(np.stack([self.kinds, step]), axis=1, return_inverse=True)
        return np.stack([*at, *(np.bincount(where.ravel(), v, at.shape[1]).astype(np.int64) for v in self.counts)])


def _split(tree: Tree, depth: int, slopes: np.ndarray) -> None:
    """Choose the splits of a level, and after the last one the values of the leaves."""
    feature, cut, value = tree
    for i, sums in enumerate(slopes / UNIT):
        at = 2**depth - 1 + i
        g, h = (np.cumsum(sums[:, :, k], 1) for k in (0, 1))
        gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
        j, k = np.unravel_index(int(gain[:, :-1].argmax()), gain[:, :-1].shape)
        if gain[j, k] > 1e-9:
            feature[at], cut[at] = j, k
        if depth == DEPTH - 1:
            j, k = feature[at], cut[at]  # without a split all are left
            for leaf, (a, b) in enumerate(((g[j, k], h[j, k]), (g[j, -1] - g[j, k], h[j, -1] - h[j, k])), 2 * at + 1):
                value[leaf] = -RATE * a / (b + 1)


def _pooled(steps: np.ndarray, rows: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Where pools of ascending steps begin and their shares of positives, which never fall."""
    pools: list[list[float]] = []  # start, positives, rows
    for s, t, n in zip(steps, positive, rows, strict=True):
        pools.append([s, float(t), float(n)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([[p[0] for p in pools], [p[1] / (p[2] + 1) for p in pools]])


def _quantiles(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``np.quantile`` of ascending values that stand for so many rows each."""
    ends, place = np.cumsum(counts), at * (counts.sum() - 1)
    low, high = (values[np.searchsorted(ends, f(place), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (place - np.floor(place))


def _edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bounds of bins: half by rows, half by distinct values, since most features are zero outside of one kind."""
    half = BINS // 2
    return np.sort(np.append(_quantiles(values, counts, np.linspace(0, 1, half + 1)[1:-1]), np.quantile(values, np.linspace(0, 1, half + 2)[1:-1])))


def _counted(x: np.ndarray) -> np.ndarray:
    """Feature, value and rows of every value of every feature."""
    parts = [(j, *np.unique(x[:, j], return_counts=True)) for j in range(FEATURES)]
    return np.concatenate([np.stack([np.full(len(v), j), v, n]) for j, v, n in parts], 1).astype(np.int64)


def _binned(edges: np.ndarray, x: np.ndarray, truth: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and bins of different examples, a row each, and their counts."""
    keys = np.concatenate([x[:, :1], Trees(edges).binned(x)], 1).astype(np.uint8)
    some, where = np.unique(np.ascontiguousarray(keys).view(f"V{FEATURES + 1}").ravel(), return_inverse=True)
    masks = (~held, ~held & truth, held, held & truth)
    return some, np.stack([np.bincount(where, m, len(some)).astype(np.int64) for m in masks])


def _block(keys: np.ndarray, counts: np.ndarray, start: float) -> Block:
    rows = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, FEATURES + 1)
    return Block(np.ascontiguousarray(rows[:, 1:].T), rows[:, 0], counts, np.full(len(rows), start))


def _start(train: int, positive: int, held: int, held_positive: int) -> float:
    positive += held_positive
    return float(np.log((positive + 1) / (train + held - positive + 1)))


def _boosted(model: Trees, slopes: Callable, steps: Callable, keep: Callable) -> Trees:
    """Grow the trees from ``slopes(trees, tree, depth)`` of all that train, and calibrate on ``steps(trees)`` of the others.

    ``keep(trees)`` adds trees to the sums of what trains; ``slopes`` is told those not added yet, ``steps`` all.
    """
    waiting: list[Tree] = []
    for _ in range(ROUNDS):
        nodes = 2 ** (DEPTH + 1) - 1
        tree = (np.zeros(nodes, np.int64), np.full(nodes, BINS), np.zeros(nodes))
        for depth in range(DEPTH):
            _split(tree, depth, slopes(waiting, tree, depth))
        model.trees.append(tree)
        waiting.append(tree)
        if len(waiting) == KEPT:
            keep(waiting)
            waiting = []
    found = steps(model.trees)
    cells, where = np.unique(found[1], return_inverse=True)
    model.steps = _pooled(cells / FINE, *(np.bincount(where.ravel(), v, len(cells)) for v in found[2:]))
    likely = model.steps[0][model.steps[1] >= LEAST]
    for at, kind in enumerate(KINDS):
        _, step, rows, positive = found[:, found[0] == at]
        step, wrong = step[rows > positive], (rows - positive)[rows > positive]
        order = np.argsort(-step)
        passed = np.searchsorted(np.cumsum(wrong[order]), int(WRONG * wrong.sum()), "right")
        least = (step[order][passed] + 1) / FINE if len(order) else -np.inf
        model.thresholds[kind] = max(least, float(likely[0]) if len(likely) else np.inf)
    return model


def _made(rnd: random.Random) -> list[tuple[str, str]]:
    """Parts of a scene."""
    parts, alike, style = [], rnd.choice([None, None, *KINDS, "phone"]), rnd.random()  # a list of one kind, or whatever comes
    for _ in range(rnd.choice([1, 1, 2, 2, 3, 4])):
        kind = alike or (rnd.choice(KINDS) if rnd.random() < 0.4 else "")
        span = invented(kind, rnd) if kind else decoy(rnd)
        bare = kind == "card" and rnd.random() < 0.7
        if bare and rnd.random() < 0.5:
            gap = rnd.choice("  -")
            span = gap.join(span[i : i + 4] for i in range(0, len(span), 4)) if len(span) == 16 else gap.join((span[:4], span[4:10], span[10:]))
        parts.append((kind, rewritten(kind, span, random.Random(style) if alike and style < 0.7 else rnd) if kind and not bare else span))
    return parts


Examples = tuple[np.ndarray, np.ndarray, np.ndarray]  # described, whether positive, whether held out


def examples_of(rows: Sequence[tuple[str, str, str, str, bool]], rnd: random.Random) -> Examples:
    """Examples from (kind, span, before, after, whether a base span); of other rows only the context is used."""
    groups = []
    for kind, span, before, after, positive in rows:
        if positive:
            groups.append([(kind, span, before, after, True)])
            groups.append(_scene([(kind, rewritten(kind, span, rnd))], before, after, rnd))
            groups.append(_scene([("", decoy(rnd))], before, after, rnd))
        else:
            groups.append(_scene(_made(rnd), before, after, rnd))
    held = np.repeat([rnd.random() < 0.3 for _ in groups], [len(group) for group in groups])
    x = np.array([described(*e[:4]) for group in groups for e in group], np.int32).reshape(-1, FEATURES)
    return x, np.array([e[4] for group in groups for e in group], bool), held.astype(bool)


def _all_edges(counted: np.ndarray) -> np.ndarray:
    by_value = [counted[1:, counted[0] == j] for j in range(FEATURES)]
    return np.array([_edges(*part[:, np.argsort(part[0])]) for part in by_value])


def fit(rows: list[tuple[str, str, str, str, bool]], seed: int = 0) -> Trees:
    """Trees from a few (kind, span, before, after, whether a base span); of other rows only the context is used."""
    rows = rows or [("", "", "", "", False)]
    contexts = [("", "", before, after, False) for _, _, before, after, _ in islice(cycle(rows), SCENES)]
    x, truth, held = examples_of([*(row for row in rows if row[4]), *contexts], random.Random(seed))
    model = Trees(_all_edges(_counted(x)))
    keys, counts = _binned(model.edges, x, truth, held)
    model.start = _start(*counts.sum(1).tolist())
    train, held = (_block(keys[at[0] > 0], at[:, at[0] > 0], model.start) for at in (counts[:2], counts[2:]))

    def keep(trees: Sequence[Tree]) -> None:
        train.sums = train.added(trees)

    return _boosted(model, train.slopes, held.steps, keep)


def _around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def places(text: str, scenes: int, rnd: random.Random) -> list[tuple[str, str, str, str, bool]]:
    """The base spans of a text, and the other contexts that it teaches; ``scenes`` of a stretch."""
    found = [(kind, *_around(text, start, end), True) for kind, start, end in base_spans(text)]
    reach = 0
    for kind, start, end in proposals(text):
        if start >= reach:
            found.append((kind, *_around(text, start, end), False))
        reach = max(reach, end)
    for start in range(0, max(len(text), 1), STRETCH):
        for _ in range(scenes):
            at = rnd.randint(start, min(start + STRETCH, len(text)))
            found.append(("", *_around(text, at, at), False))
    return found


EXAMPLES = "x array<int>, truth boolean, held boolean"
KEYED = "key binary, train long, positive long, held long, held_positive long"
BLOCKS = "bins binary, kinds binary, counts binary, sums binary"


def examples(docs: DataFrame) -> DataFrame:
    """What the whole texts of all documents teach; copies of a text teach the same, each time."""
    n = docs.count()
    texts = docs.select("text") if n else docs.sparkSession.createDataFrame([("",)], "text string")
    scenes = -(-SCENES // max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in (value.as_py() or "" for value in batch.column(0)):
                rnd = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
                found = places(text, scenes, rnd)
                for at in range(0, len(found), BLOCK):  # a text may have very many
                    yield examples_of(found[at : at + BLOCK], rnd)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Examples] = []
        for part in chain(run(batches), [None]):
            parts += [part] if part else []
            if parts and (part is None or sum(len(x) for x, _, _ in parts) >= BLOCK):
                x, truth, held = map(np.concatenate, zip(*parts, strict=True))
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, x.ravel())
                yield pa.RecordBatch.from_arrays([lists, pa.array(truth), pa.array(held)], names=["x", "truth", "held"])
                parts = []

    return texts.mapInArrow(blocks, EXAMPLES)


def _row(*values: np.ndarray, names: str) -> pa.RecordBatch:
    """One row of arrays as bytes."""
    columns = [pa.array([v.tobytes()], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in names.split(", ")])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[Examples]:
    for x, truth, held in (batch.columns for batch in batches):
        flat = x.flatten().to_numpy(zero_copy_only=False)
        yield flat.reshape(-1, FEATURES), *(v.to_numpy(zero_copy_only=False).astype(bool) for v in (truth, held))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    types = (np.uint8, np.uint8, np.int64, np.float64)
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            bins, kinds, counts, sums = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, types, strict=True))
            yield Block(bins.reshape(FEATURES, -1), kinds, counts.reshape(2, -1), sums)


def _written(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    for b in blocks:
        yield _row(b.bins, b.kinds, b.counts, b.sums, names=BLOCKS)


def _longs(names: str, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[c.split()[0] for c in names.split(", ")])


def learn(docs: DataFrame) -> Trees:
    """Fit on all documents."""
    with passing(docs.sparkSession):
        taught = settle(examples(docs), "pii-examples")
        model = Trees(_edges_of(taught))
        keyed = settle(_keyed(taught, model.edges), "pii-binned")
        totals = keyed.agg(*[F.sum(c) for c in keyed.columns[1:]]).first()
        model.start = _start(*totals)
        return _boosted(model, *_over(keyed, model.start))


def _edges_of(taught: DataFrame) -> np.ndarray:
    names = "feature long, value long, rows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _ in _described(batches):
            yield _longs(names, _counted(x))

    values = taught.mapInArrow(run, names).groupBy("feature", "value").agg(F.sum("rows"))
    return _all_edges(np.array(values.collect(), np.int64).T)  # different values of 37 small numbers


def _keyed(taught: DataFrame, edges: np.ndarray) -> DataFrame:
    """Different binned examples, and how many there are of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in KEYED.split(", ")]
        for x, truth, held in _described(batches):
            keys, counts = _binned(edges, x, truth, held)
            columns = [pa.array([k.tobytes() for k in keys], pa.binary()), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = taught.mapInArrow(run, KEYED)
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])


def _over(keyed: DataFrame, start: float) -> tuple[Callable, Callable, Callable]:
    """``slopes``, ``steps`` and ``keep`` of ``_boosted`` over examples in Spark."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8)
            counts = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield from _written([_block(keys, counts, start)])

    def blocked(n: str, positive: str) -> DataFrame:
        return settle(keyed.where(F.col(n) > 0).select("key", n, positive).mapInArrow(blocks, BLOCKS), "pii-blocks")

    train, held = [blocked("train", "positive")], blocked("held", "held_positive")

    def slopes(trees: Sequence[Tree], tree: Tree, depth: int) -> np.ndarray:
        trees = list(trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2**depth, FEATURES, BINS + 1, 2), np.int64)
            for block in _blocks(batches):
                total += block.slopes(trees, tree, depth)
            yield _row(total, names="slopes binary")

        parts = train[0].mapInArrow(run, "slopes binary").collect()  # a task's sums, some 40 KB at most
        return sum(np.frombuffer(p[0], np.int64).reshape(2**depth, FEATURES, BINS + 1, 2) for p in parts)

    def steps(trees: Sequence[Tree]) -> np.ndarray:
        trees, names = list(trees), "kind long, step long, rows long, positive long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                yield _longs(names, block.steps(trees))

        found = held.mapInArrow(run, names).groupBy("kind", "step").agg(F.sum("rows"), F.sum("positive"))
        return np.array(found.collect(), np.int64).reshape(-1, 4).T  # at most 2 * FAR * FINE steps of each kind

    def keep(trees: Sequence[Tree]) -> None:
        trees = list(trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _written(Block(b.bins, b.kinds, b.counts, b.added(trees)) for b in _blocks(batches))

        train[0] = settle(train[0].mapInArrow(run, BLOCKS), "pii-blocks")

    return slopes, steps, keep


def all_spans(texts: list[str], model: Trees) -> list[list[tuple[str, int, int, bool, float]]]:
    """Per text the base spans and the accepted proposals: kind, start, end, whether base, score."""
    certain = [base_spans(text) for text in texts]
    out, taken = [[(*span, True, 1.0) for span in spans] for spans in certain], [sorted((s, e) for _, s, e in spans) for spans in certain]
    latest = [np.maximum.accumulate([e for _, e in spans]) if spans else () for spans in taken]
    accepted: dict[int, list[tuple[float, str, int, int, float]]] = {}
    block: list[tuple[int, str, int, int]] = []

    def settle_block(done: int) -> None:
        """Score the proposals at hand, and choose among those of the texts before ``done``."""
        if block:
            x = np.array([described(kind, *_around(texts[at], start, end)) for at, kind, start, end in block], float)
            sums = model.sums(x)
            for i in np.flatnonzero(sums >= np.array([model.thresholds[kind] for _, kind, _, _ in block])):
                at, *span = block[i]
                accepted.setdefault(at, []).append((float(sums[i]), *span, float(model.scores(sums[i : i + 1])[0])))
            block.clear()
        for at in [at for at in accepted if at < done]:
            out[at] += _apart(accepted.pop(at))

    for at, text in enumerate(texts if model.trees else ()):
        for kind, start, end in proposals(text):
            before = bisect_left(taken[at], (end,)) - 1  # the last base span that begins before the end
            if before < 0 or latest[at][before] <= start:
                block.append((at, kind, start, end))
                if len(block) == BLOCK:
                    settle_block(at)
    settle_block(len(texts))
    return [sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])) for spans in out]


def _apart(accepted: list[tuple[float, str, int, int, float]]) -> list[tuple[str, int, int, bool, float]]:
    """The proposals of a text that overlap no better one."""
    chosen: list[tuple[int, int]] = []  # apart from each other and in order
    out = []
    for _, kind, start, end, score in sorted(accepted, key=lambda a: -a[0]):
        i = bisect_left(chosen, (start, end))
        if (i == 0 or chosen[i - 1][1] <= start) and (i == len(chosen) or end <= chosen[i][0]):
            chosen.insert(i, (start, end))
            out.append((kind, start, end, False, score))
    return out


SPAN = "struct<kind:string,start:int,end:int,base:boolean,score:double>"
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
ROWS = 512  # texts that are in Python's memory at once


def _spans_column(docs: DataFrame, model: Trees) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some tens of small trees

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), ROWS):
                texts = [text or "" for text in batch.slice(at, ROWS).to_pylist()]
                rows = [[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans] for spans in all_spans(texts, shared.value)]
                parts.append(pa.array(rows, pa.list_(_ARROW)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_ARROW))

    return F.arrow_udf(run, f"array<{SPAN}>")(F.col("text"))


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end, base and score, by kind as listed and start."""
    return unpacked(packed(docs, spans=_spans_column(docs, model)), docs, "spans")


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans are replaced as one."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans, strict=True):
            text, end = text.as_py(), 0
            if text is not None:
                parts = []
                for span in sorted(found.as_py(), key=lambda s: (s["start"], -s["end"])):
                    if span["start"] >= end:
                        parts += [text[end : span["start"]], f"[{span['kind'].upper()}]"]
                    end = max(end, span["end"])
                text = "".join(parts) + text[end:]
            out.append(text)
        return pa.array(out, pa.string())

    rows = packed(docs, text=F.col("text"), spans=_spans_column(docs, model))
    return unpacked(rows.select("row", F.arrow_udf(run, "string")("text", "spans").alias("text")), docs, "text")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
