"""Candidate pairs of near duplicates are judged natively."""

from __future__ import annotations

from hibiki.llm import simhash


def test_verified_links_send_no_pair_of_sets_to_python(spark):
    """The similarity of a candidate pair is told natively, and its groups whole."""
    sets = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5, 6]), (3, [-7, 8]), (4, [1, 2, 3, 4, 6, 5])], "node long, s array<int>")
    found = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {tuple(r) for r in simhash.verified(found, sets, 0.8).collect()}
    assert {(1, 2)} <= got and all(3 not in p for p in got) and any(4 in p for p in got)
