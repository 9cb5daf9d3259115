"""Python functions over rows: slices bounded by their weight, rows dealt over all tasks, work that is done once."""

from pyspark.sql import functions as F

from hibiki import queries
from hibiki.functions import english
from hibiki.operators import tokens
from hibiki.plans import rows


def test_slices_are_bounded_by_what_they_hold(spark):
    df = spark.range(0, 600, 1, 1).select("id", F.expr("CASE WHEN id = 7 THEN NULL WHEN id = 9 THEN repeat('x', 50000) ELSE repeat('x', 500) END").alias("text"))
    out = rows.mapped(df, "n", "array<int>", lambda values: [None if v is None else [len(v), len(values)] for v in values], F.col("text"))
    got = {r.id: r.n for r in out.select("id", "n").collect()}
    assert len(got) == 600 and got[7] is None and got[9] == [50000, 1]
    assert max(n[1] for n in got.values() if n) <= 33
    assert all(n[0] == 500 for k, n in got.items() if k not in (7, 9))


def test_token_queries_are_dealt_over_all_tasks(spark):
    d = "/root/testdata/sf0.001"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("merge_ruby", "tokenize_together", "english_line", "char_index"):
        assert queries.queries()[name](spark, d).rdd.getNumPartitions() == n, name


def test_prefixes_are_made_once():
    assert english._prefixes() is english._prefixes()


def test_numbers_of_a_fold_are_kept_as_text(spark):
    df = spark.sql("SELECT array('名詞', '助詞', null, '動詞') AS p UNION ALL SELECT array() UNION ALL SELECT null")
    plan = df.select(tokens.phrase_numbers(F.col("p")).alias("n"))
    assert sorted(map(str, (r.n for r in plan.collect()))) == ["None", "[0, 0, 0, 1]", "[]"]


def test_kanji_texts_join_the_dictionary_alone(spark):
    from hibiki.sources import dictionary

    df = spark.sql("SELECT 1 AS k, '山x川' AS t UNION ALL SELECT 2, '' UNION ALL SELECT 3, null UNION ALL SELECT 4, 'abc'")
    table = spark.sql("SELECT '山' AS kanji, array('サン') AS readings UNION ALL SELECT '川', array('カワ') UNION ALL SELECT 'a', array()")
    out = dictionary.kanji_texts(df, "k", "t", table, "o")
    assert {r.k: r.o for r in out.collect()} == {1: "サンカワ", 2: "", 3: None, 4: ""}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
