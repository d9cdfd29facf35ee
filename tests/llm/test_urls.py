from __future__ import annotations

import math

from marquee.llm import urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")]


def pages(spark, found):
    return spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(found)], "page_id long, url string, bound int, host string")


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, good int")


def judged(spark, found, rows=(), **options):
    out = urls.judge(pages(spark, found), outcomes(spark, list(rows)), RULES, **options)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_hosts_paths_and_rules(spark):
    found = judged(spark, [
        "https://WWW.Example.ORG/es/a?b#c", "http://example.org/en/123", "http://example.org/en/2", "x://example.org", "http://badexample.org/es/",
        "http://a.com/de/?x://y", "no scheme", None, "", "http://É.com#/de/", "http://h/p://q/", "http://org/es/", "a\nb://n.org/\nx", "http://u@h.com:80/de/x",
    ])
    assert [found[i] for i in range(14)] == [
        ("www.example.org", "/es/a", "example.org/es/", "block"), ("example.org", "/en/123", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("example.org", "", None, "allow"), ("badexample.org", "/es/", "org/", "allow"),
        ("a.com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("É.com", "", None, "allow"), ("h", "/p://q/", None, "allow"), ("org", "/es/", "org/", "allow"), ("n.org", "/\nx", "org/", "allow"),
        ("u@h.com:80", "/de/x", None, "allow"),
    ]


def test_domains(spark):
    from pyspark.sql import functions as F

    names = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.net:8080": ("net", "example.net"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("1", "10.0.0.1"), "": ("", "")}
    rows = spark.createDataFrame([(n,) for n in names], "h string").select("h", urls.suffix_of(F.col("h")), urls.domain_of(F.col("h"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == names


def test_reputation_is_shrunk_and_bad_hosts_go(spark):
    found = [f"http://good.one.net/{i}" for i in range(60)] + [f"http://bad.two.net/{i}" for i in range(60)]
    found += [f"http://few.two.net/{i}" for i in range(2)] + ["http://unseen.one.net/", "http://unseen.xyz/"]
    rows = [(i, 1) for i in range(60)] + [(60 + i, int(i < 6)) for i in range(60)] + [(120, 0), (121, None), (9999, 0), (0, None)]
    verdicts = {k: v[3] for k, v in judged(spark, found, rows).items()}
    assert all(verdicts[i] == "allow" for i in range(60)) and all(verdicts[i] == "block" for i in range(60, 120))
    assert verdicts[122] == verdicts[123] == "allow"  # no evidence of their own
    known = urls.reputations(pages(spark, found).selectExpr("page_id", "parse_url(url, 'HOST') host"), outcomes(spark, rows))
    means = {r.host: (r.good, r.n, r["mean"]) for r in known.collect()}
    assert means["bad.two.net"][:2] == (6, 60) and means["few.two.net"][:2] == (0, 1)
    assert 6 / 60 < means["bad.two.net"][2] < 0.3  # drawn towards its domain
    assert 0 < means["few.two.net"][2] < 0.5 and means["unseen.one.net"][2] > 0.7
    assert all(math.isfinite(m) for _, _, m in means.values())


def test_without_evidence_nothing_is_blocked_by_the_method(spark):
    assert judged(spark, ["http://a.b/", "http://c.d/"]) == {0: ("a.b", "/", None, "allow"), 1: ("c.d", "/", None, "allow")}
    assert judged(spark, []) == {}
