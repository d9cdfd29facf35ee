from __future__ import annotations

from marquee.operators.postings import match_all_terms, token_index


def test_postings_and_search(spark):
    docs = spark.createDataFrame(
        [(1, "The cat, the CAT and Éa-12"), (2, "a cat sat"), (3, ""), (4, None), (5, "sat")], "doc_id int, text string"
    )
    postings = token_index(docs)
    assert {tuple(r) for r in postings.collect()} == {
        ("cat", 1, 2), ("éa", 1, 1), ("12", 1, 1), ("cat", 2, 1), ("sat", 2, 1), ("sat", 5, 1),
    }
    assert {tuple(r) for r in match_all_terms(postings, ["Sat", "cat", "cat"]).collect()} == {(2, 2)}
    assert match_all_terms(postings, ["dog"]).count() == 0
