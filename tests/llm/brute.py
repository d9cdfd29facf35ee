"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, width: int) -> frozenset:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_copies(docs: list[tuple[int, str | None]], width: int, over: int, under: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id of its group), by comparing all pairs that share a shingle."""
    sets = {k: shingle_set(text, width) for k, text in docs}
    holders, parent = defaultdict(list), {k: k for k in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in sets.items():
        shared = Counter(j for s in own for j in holders[s])
        for j, n in shared.items():
            if under * n >= over * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
        for s in own:
            holders[s].append(k)
    return {k: (len(own), find(k)) for k, own in sets.items()}
