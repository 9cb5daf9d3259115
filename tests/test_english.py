"""Native romaji against the character machine."""

import random

from pyspark.sql import functions as F

from hibiki.functions import english


def test_native_kana(spark):
    rng = random.Random(4)
    cases = ["", "shinbun", "Love", "LOVE", "kk", "nn", "n", "N", "kan", "kana'n", "tta", "xtsu", "Ｌove", "aＢc", "İstanbul", "K", "it's", "日本go", "q", "ｑ", "nna", "nya", "ny", "shh", "fyi", "vv", "don't", "an", "aN", "x😀y"]
    cases += ["".join(rng.choice("aeiounnkksthyrqxlNK'日 ") for _ in range(rng.randrange(1, 14))) for _ in range(2_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string").repartition(4)
    rows = df.select("i", english.roman_letters_to_kana(F.col("t")).alias("r"), english.english_to_kana(F.col("t")).alias("k"))
    got = {r.i: r for r in rows.collect()}
    for i, t in enumerate(cases):
        assert got[i].r == english.roman_to_kana(t), t
        assert got[i].k == english.to_kana(t), t
    assert got[len(cases)].r is None and got[len(cases)].k is None
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_readings_made_uniform(spark):
    df = spark.createDataFrame([(0, "ねこloveネコ"), (1, "shinbun！"), (2, None), (3, ""), (4, "it's ok"), (5, "かあ\nca")], "i int, t string")
    got = {r.i: r.o for r in df.select("i", english.format_kana(F.col("t")).alias("o")).collect()}
    assert got[0] == "ネコラヴネコ" and got[1] == "シンブン" and got[2] is None and got[3] == ""
