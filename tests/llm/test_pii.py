from __future__ import annotations

import random
import tracemalloc
import re

import pytest

from marquee.llm import pii

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1]))) % 10 == 0
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PARTS = ["a", "b@", "@", ".", "c.d", "1", "23", "+", "+1", "(", ")", " ", "-", "999", "255", "4111 1111 1111 1111", "é", "1.2.3.4", "%", "\n", "0001", "🙂"]


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_equal_the_patterns(seed):
    rnd = random.Random(seed)
    for _ in range(20_000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "x@" + "a-" * 100_000, "(at)" * 50_000, "1:" * 100_000, "+" * 100_000):
        pii.base_spans(text), sum(1 for _ in pii.proposals(text))


SCHEMA = "doc_id long, text string, spans int"


def corpus():
    rnd = random.Random(0)
    words, out = "the of and thon erin data we call mail".split(), []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(30)]
        text[5] = rnd.choice([f"jo.{i}@mail{i % 9}.example.com", f"+1 ({rnd.randint(200, 999)}) 555-{i:04}", f"10.{i % 256}.3.4", f"version {i % 9}.0", f"order {i:09}"])
        out.append((i, " ".join(text)))
    return out + [(1000, None), (1001, ""), (None, "x@y.zz"), (3, out[3][1]), (1002, "é🙂 " + "x@y.zz " * 3000)]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(*r, 1) for r in corpus()], SCHEMA).repartition(3)
    model = pii.learn(docs)
    return docs, model


def test_spans_of_documents(spark, found):
    docs, model = found
    rows = pii.find(docs, model).collect()
    assert len(rows) == len(corpus())
    texts = {r[0]: r[1] for r in corpus()}
    for row in rows:
        assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == brute(texts[row.doc_id] or "")
        assert row.spans == sorted(row.spans, key=lambda s: (pii.KINDS.index(s.kind), s.start))


def test_accepted_proposals_and_clean_text(found):
    _, model = found
    assert model.trees and set(model.thresholds) == set(pii.KINDS)
    texts = ["write to joe (at) mail7.example (dot) com now", "no numbers here", "version 2.0 of 2024-05-17", "page 12 of 345"]
    spans = pii.all_spans(texts, model)
    assert [(k, texts[0][s:e], b) for k, s, e, b, _ in spans[0]] == [("email", "joe (at) mail7.example (dot) com", False)]
    assert spans[1:] == [[], [], []]


NEIGHBOURS = [
    ("0612345678 0698765432", [("phone", "0612345678"), ("phone", "0698765432")]),
    ("(555) 123-4567 (555) 987-6543 (555) 222-3333", [("phone", "(555) 123-4567"), ("phone", "(555) 987-6543"), ("phone", "(555) 222-3333")]),
    ("(555) 123-4567 2024-05-01", [("phone", "(555) 123-4567")]),
    ("4111111111111111 5500000000000004", [("card", "4111111111111111"), ("card", "5500000000000004")]),
    ("2001:db8::1 and fe80::1ff:fe23:4567:890a", [("ip", "2001:db8::1"), ("ip", "fe80::1ff:fe23:4567:890a")]),
]


@pytest.mark.parametrize("text, wanted", NEIGHBOURS)
def test_neighbours_are_proposed_and_found(found, text, wanted):
    _, model = found
    text = f"the {text} of"
    assert set(wanted) <= {(k, text[s:e]) for k, s, e in pii.proposals(text)}
    assert [(k, text[s:e]) for k, s, e, _, _ in pii.all_spans([text], model)[0]] == wanted


def test_every_window_of_a_run_is_proposed():
    run = " ".join(f"{i:03}" for i in range(200))
    found = {(k, s, e) for k, s, e in pii.proposals(run)}
    for i in range(200):
        for n in range(1, 9):
            if i + n <= 200:
                assert (("phone", 4 * i, 4 * (i + n) - 1) in found) == (3 <= n <= 5) and (("card", 4 * i, 4 * (i + n) - 1) in found) == (5 <= n <= 6)


def test_long_addresses():
    good = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "fe80::", "1:2:3:4:5:6:7:8", "ip:2001:db8::1", "[2001:db8::1]:80", "2001:db8::1: down", "at 2001:db8::1/64"]
    spans = ["2001:db8::1", "fe80::1ff:fe23:4567:890a", "::1", "fe80::", "1:2:3:4:5:6:7:8", "2001:db8::1", "2001:db8::1", "2001:db8::1", "2001:db8::1"]
    assert [[t[s:e] for _, s, e in pii.proposals(t)] for t in good] == [[s] for s in spans]
    assert [list(pii.proposals(t)) for t in ("::", "12:30", "std::dec", "1::2::3", "12345::1", "1:2:3:4:5:6:7:8:9", ":::", "a:::b", "2001:db8::1z")] == [[]] * 9


LOOSE = [
    lambda i, rnd: ("email", f"ann{i} (at) mail{i % 9}.example (dot) com"),
    lambda i, rnd: ("ip", ":".join(["2001", "db8", *(f"{rnd.randrange(65536):x}" for _ in range(6))])),
    lambda i, rnd: ("phone", f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{i:04}"),
    lambda i, rnd: ("phone", f"0{rnd.randint(1, 9)}{rnd.randint(10**7, 10**8 - 1)}"),
]
NOBODYS = ["order 000000123", "sold (at) 12.50 each", "mac 00:1a:2b:3c:4d:5e", "version 2.0 of 2024-05-17", "id 2123465659789240"]


@pytest.mark.parametrize("with_base", [False, True])
def test_what_a_corpus_is_full_of_is_found(spark, with_base):
    rnd, rows = random.Random(3), []
    for i in range(1200):
        words = [rnd.choice("the of and thon erin data we call".split()) for _ in range(20)]
        kind, words[9] = LOOSE[i % 4](i, rnd)
        if with_base and i % 3 == 0:
            words[3] = rnd.choice([f"jo.{i}@mail.example.com", f"+1 (555) 555-{i:04}", f"10.{i % 256}.3.4"])
        text = " ".join(words)
        rows.append((i, text, 1, (kind, text.index(words[9]), text.index(words[9]) + len(words[9]))))
    model = pii.learn(spark.createDataFrame([r[:3] for r in rows], SCHEMA))
    found = pii.all_spans([r[1] for r in rows], model)
    missed = [r for r, spans in zip(rows, found, strict=True) if r[3] not in [s[:3] for s in spans]]
    assert {kind: sum(r[3][0] == kind for r in missed) for kind in pii.KINDS} == {k: pytest.approx(0, abs=n) for k, n in zip(pii.KINDS, (0, 6, 0, 12), strict=True)}
    assert pii.all_spans(NOBODYS, model) == [[]] * len(NOBODYS)


def test_redaction(spark, found):
    docs, model = found
    rows = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert rows[1000] is None and rows[1001] == "" and rows[None] == "[EMAIL]" and rows[1002] == "é🙂 " + "[EMAIL] " * 3000


def test_without_anything_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = pii.learn(empty)
    assert model.trees and pii.find(empty, model).count() == 0
    spans = pii.all_spans(["a@b.cc and joe (at) mail.example (dot) com"], model)[0]
    assert spans[0] == ("email", 0, 6, True, 1.0) and [s[:4] for s in spans[1:]] == [("email", 11, 42, False)]


def test_a_sample_without_proposals_still_teaches(spark):
    """Personal data may be too rare for the sample to hold any: the trees then know it from made scenes alone."""
    rnd = random.Random(5)
    words = "the of and thon erin data we call mail in to".split()
    plain = [(i, " ".join(rnd.choice(words) for _ in range(40)), 1) for i in range(300)]
    assert not any(next(pii.proposals(text), None) for _, text, _ in plain)
    model = pii.learn(spark.createDataFrame([*plain, (900, None, 1), (901, "", 1)], SCHEMA))
    for make in LOOSE:
        found = 0
        for i in range(200):
            kind, span = make(i, rnd)
            before, after = (" ".join(rnd.choice(words) for _ in range(12)) for _ in range(2))
            text = f"{before} {span} {after}"
            found += (kind, len(before) + 1, len(before) + 1 + len(span)) in [s[:3] for s in pii.all_spans([text], model)[0]]
        assert found >= 180, (kind, found)
    assert pii.all_spans([text for _, text, _ in plain], model) == [[]] * len(plain)


def test_all_documents_teach(spark, monkeypatch):
    """However many documents there are, the trees follow from each of them, and not from how rows lie in tasks."""
    monkeypatch.setattr(pii, "ROUNDS", 2)
    rows = [(i, f"the word of {i} and", 1) for i in range(3300)]
    plain = spark.createDataFrame(rows, SCHEMA)
    chosen = plain.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h", "doc_id").collect()
    told = {r.doc_id for r in chosen[3000:]}  # behind the first 3000 by hash
    docs = spark.createDataFrame([(i, f"{text} mail jo.{i}@mail.example.com" if i in told else text, 1) for i, text, _ in rows], SCHEMA)

    def facts(model):
        return model.start, model.thresholds, model.edges.tolist(), model.steps.tolist(), [[part.tolist() for part in tree] for tree in model.trees]

    model = facts(pii.learn(docs))
    assert model != facts(pii.learn(plain))
    assert model == facts(pii.learn(docs.repartition(7)))


def test_every_base_span_and_stretch_is_a_place():
    text = "x@y.zz " * 100 + "a " * pii.STRETCH + "call 555 123 4567 or (555) 987-6543"
    found = pii.places(text, 1, random.Random(0))
    assert sum(row[4] for row in found) == 100 and [row[0] for row in found if not row[4]].count("") == len(text) // pii.STRETCH + 1
    assert len(pii.places("a@" + "b" * 300 + ".org", 3, random.Random(0))) == 4  # however long


def test_long_numeric_texts_are_proposed_one_by_one():
    """A log of numbers has more windows than memory should hold at once."""
    text = "12 3456 789 01 " * 40_000
    tracemalloc.start()
    n = sum(1 for _ in pii.proposals(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 400_000 and peak < 1_000_000


def test_texts_are_settled_one_by_one(monkeypatch):
    """However proposals fall into blocks, the chosen spans are the same."""
    model = pii.fit([("email", "jo@x.org", "write to ", " now", True)])
    texts = ["call (555) 123-4567 or 0612345678 0698765432", "", "joe (at) mail7.example (dot) com", "12 34 56 78 90 12 34 56 78 90", "x"]
    whole = pii.all_spans(texts, model)
    for size in (1, 2, 7):
        monkeypatch.setattr(pii, "BLOCK", size)
        assert pii.all_spans(texts, model) == whole
