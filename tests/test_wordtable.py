"""The word table of the queries reads a word once, however many places it has."""

from __future__ import annotations

from hibiki import queries


def test_words_are_told_after_they_are_grouped(spark):
    df = spark.createDataFrame([("Kana kana KANA xq sakura",), (None,), ("kana",)], "text string")
    words = queries.romaji_words(df)
    assert sorted(r.w for r in words.collect()) == ["kana", "sakura"]
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    grouped = next(i for i, x in enumerate(lines) if "Aggregate" in x)
    tests = [i for i, x in enumerate(lines) if "RLIKE" in x]
    assert tests and max(tests) < grouped  # the plan prints from the last step down
