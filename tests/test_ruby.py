"""Native ruby parsing against the character machine."""

import random

from pyspark.sql import functions as F

from hibiki.functions import ruby


def test_native_parsing(spark):
    rng = random.Random(2)
    cases = ["", "｜空《そら》", "｜a｜b《よみ》", "|a《》", "｜《よ》", "｜a\n《よ》", "\\｜a《よ》", "\\\\｜a《よ》", "a\\", "｜a\\《b《よ\\》み》x", "《a》", "｜a《b｜c》", "｜\\x《\\y》", "x｜a《よ》｜b《み》", "😀｜😀😀《ア》z", "a｜b《c》\r\n｜d《e》"]
    cases += ["".join(rng.choice("aあ｜|《》\\\n𠮷") for _ in range(rng.randrange(30))) for _ in range(1_500)]
    cases += ["｜" + "長" * 20_000 + "《" + "な" * 20_000 + "》", "x" * 100_000, "\\｜" * 3_000, "｜a《b》" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string").repartition(4)
    rows = df.select("i", ruby.ruby_parse(F.col("t")).alias("p"), ruby.ruby_split(F.col("t")).alias("s"))
    got = {r.i: r for r in rows.collect()}
    for i, t in enumerate(cases):
        want = ruby.parse(t)
        assert got[i].p.plain == want["plain"] and [a.asDict() for a in got[i].p.annotations] == want["annotations"], t[:50]
        assert [x.asDict() for x in got[i].s] == ruby.pieces(t), t[:50]
    assert got[len(cases)].p.plain is None and got[len(cases)].p.annotations is None and got[len(cases)].s is None
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
