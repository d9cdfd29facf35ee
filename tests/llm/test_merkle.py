from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from marquee.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0) -> str:
    doc_id, text, lang, source, n_chars = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what it is hashed with on its way there."""
    ways, nodes, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for place, own in enumerate(members):
            run, at = runs[place // arity], place % arity
            for i in own:
                ways[i].append(("".join(run[:at]), "".join(run[at + 1 :])))
        members = [sum(members[i : i + arity], []) for i in range(0, len(nodes), arity)]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], ways


def brute(rows, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]], arity)
    root, tops = tree([trees[lang][0] for lang in langs], arity)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for row, way in zip(groups[lang], trees[lang][1], strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            found = leaf(row, more=int(bad))
            for before, after in way + top:
                found = sha(before + found + after)
            proof = sha("".join(b + a for b, a in way + top))
            out.append((row[0], leaf(row), trees[lang][0], root, proof, found, found == root))
    return sorted(out, key=str)


def made(spark, rows):
    extra = ", leaf int, Root string, `group` string, item int, digest0 int"
    return spark.createDataFrame([(*r, 1, "r", "g", 2, 3) for r in rows], SCHEMA + extra)


ROWS = [(i * 3 % 211, f"text {i} é日", ["en", "en", "fr", None, "de"][i % 5 if i < 190 else 0], f"s{i % 3}", i) for i in range(211)]
ROWS += [(500, None, None, None, None), (None, "no id", "en", "", 0), (None, "no id", "en", "", 0), (7, "again", "en", "s", 5), (7, "again", "en", "s", 5)]
ROWS += [(7, "again", "en", "s", None), (8, "", "", "s", 2**63 - 1), (49, "x" * 300_000, "long", "s", -1), (9, "a:b-", "1:a", "-", 0)]


@pytest.mark.parametrize("shape", [merkle.Shape(2, 6), merkle.Shape(2, 2), merkle.Shape(3, 1)])
def test_equals_brute_force(spark, shape):
    out = merkle.manifest(made(spark, ROWS).repartition(5), shape)
    assert sorted(map(tuple, out.collect()), key=str) == brute(ROWS, shape.arity)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_heights(spark, n):
    rows = [(i, str(i), "en", "s", i) for i in range(n)]
    out = merkle.manifest(made(spark, rows), merkle.Shape(2, 2)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_altered_rows_are_found_out_and_others_are_not(spark):
    out = merkle.manifest(made(spark, ROWS)).collect()
    bad = {r[0] for r in ROWS if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert bad and all(r.verified == (r.doc_id not in bad) for r in out)


def test_empty_table(spark):
    assert merkle.manifest(made(spark, [])).count() == 0


def test_any_table_can_be_proved(spark):
    rows = spark.range(40).selectExpr("id", "id % 2 = 0 part", "sha2(cast(id as string), 256) leaf", "id * 2 twice")
    out = merkle.prove(rows, "part", ["id"], ["twice"], merkle.Shape(4, 2))
    assert out.columns == ["part", "id", "twice", "leaf", "way", "subroot", "root"]
    assert out.where(merkle.folded(out.leaf, out.way) != out.root).count() == 0 and out.count() == 40
    assert out.where("twice <> id * 2 or leaf <> sha2(cast(id as string), 256)").count() == 0
