from __future__ import annotations

from collections import Counter, defaultdict

from marquee.llm.lines import drop_boilerplate

SCHEMA = "doc_id long, text string, source string, marks int, kept string"


def brute(rows, ratio, min_pages):
    held, pages = defaultdict(Counter), Counter()
    for _, text, source in rows:
        pages[source] += 1
        for line in {part.strip(" \t\r") for part in (text or "").split("\n")} - {""}:
            held[source][line] += 1
    out = []
    for doc_id, text, source in rows:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        bad = {k for k, n in held[source].items() if n >= min_pages and n > ratio * pages[source]}
        lines = text.split("\n")
        kept = [part for part in lines if part.strip(" \t\r") not in bad]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rows = []
    for i in range(300):
        source = ["hot", "hot", "b", None, "few"][i % 5 if i < 280 else 4]
        lines = [f"own line {i}", "Menu | Home ", "\tMenu | Home\r"] if i % 2 else [f"own {i}", "", "  "]
        lines += ["rare footer"] * (i % 50 == 0) + ["x" * 5000] * (i % 3 == 0)
        rows.append((i, "\n".join(lines), source))
    rows += [(900, None, "hot"), (901, "", "hot"), (None, "Menu | Home", "hot"), (5, rows[5][1], rows[5][2]), (902, "\n\n", None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA).repartition(4)
    for ratio, least in ((0.1, 2), (0.1, 5), (0.3, 2), (0.0, 1)):
        out = drop_boilerplate(docs, ratio=ratio, min_pages=least)
        found = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str)
        assert found == brute(rows, ratio, least)
        assert set(docs.columns) <= set(out.columns) and {r.kept for r in out.collect()} == {"k"}


def test_hosts_of_few_pages(spark):
    """Menus go from hosts of 2 to 20 pages, whatever shows on one page only stays."""
    rows = []
    for pages in range(1, 21):
        for page in range(pages):
            text = ["Menu", f"own {page}", "now and then"] if page < 2 else ["Menu", f"own {page}"]
            rows.append((100 * pages + page, "\n".join(text), f"host{pages}"))
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA).repartition(3)
    found = {r.doc_id: (r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate(docs).collect()}
    assert sorted(found.values(), key=str) == brute(rows, 0.1, 2)
    assert found[100][1] == "Menu\nown 0\nnow and then" and found[200][1] == "own 0" and found[1900][1] == "own 0"
    assert found[2000][1] == "own 0\nnow and then"  # on a tenth of the pages, not on more


def test_empty_table(spark):
    assert drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
