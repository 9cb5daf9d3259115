"""The segmentation queries on small tables of their own."""

from hibiki import queries_more
from hibiki.operators import segment


def tables(spark, path, turns, words):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "mori no naka")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_lines_are_turns(spark, tmp_path):
    d = tables(spark, tmp_path, [(7, 0, "user", "Kaki kuke"), (7, 1, "bot", "saki"), (9, 0, "user", "tomo")], ["kaki", "kuke", "saki", "tomo"])
    for query in (queries_more.segment_dp, queries_more.generate, queries_more.locks):
        got = query(spark, d).select("song", "line").distinct().collect()
        assert sorted((r.song, r.line) for r in got) == [(7, 0), (7, 1), (9, 0)], query


def test_words_of_any_length(spark, tmp_path):
    d = tables(spark, tmp_path, [(7, 0, "user", "aoeaoeaoeao ea")], ["aoeaoeaoeaoe", "sutu"])
    n = len(queries_more.song_lines(spark, d).first().units)
    assert n > 8 and [(w.i, w.t, w.filler) for w in queries_more.segment_dp(spark, d).sort("word").collect()] == [(0, n, False)]
    assert [(w.i, w.t, w.filler) for w in queries_more.generate(spark, d).sort("word").collect()][0] == (0, n, False)


def test_silent_units_do_not_count(spark):
    lines = spark.createDataFrame([(1, ["カ", "ン", "ン", "キ"]), (2, [])], "line long, units array<string>")
    got = sorted((r.i, r.t) for r in segment.segments(lines, 1).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_tree_against_joins(spark, tmp_path):
    """The prefix tree gives the ranks of the joins, and a cover of the joins' candidates."""
    from pyspark.sql import functions as F

    from hibiki import queries
    from hibiki.operators import distance, lattice

    said = "kaki kuke saki tomo kokka senshu ringo momo neko tonari kanpai raamen aoi umi".split()
    d = tables(spark, tmp_path, [(1, 0, "user", "kakiku ringo neko"), (1, 1, "bot", "sakana tomo kaki"), (2, 0, "user", "aoi umi kanpai")], said)
    words, dist = queries.match_words(spark, d), distance.unit_matrix(spark)
    targets = spark.createDataFrame([("a", ["カッ", "キ"]), ("b", ["ト", "モ", "ン"]), ("c", ["x"]), ("d", [])], "target string, syllables array<string>")
    want = distance.ranked(distance.nearest(targets, words, dist, 4.0)).select("target", "id", "sim", "n_units", "seq", "rank")
    got = lattice.nearest(targets, words, dist, 4.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    lines = queries_more.song_lines(spark, d)
    made = queries_more.generate(spark, d).collect()
    runs = segment.segments(lines.select(F.struct("song", "line").alias("line"), "units"), words.agg(F.max("n_units")).first()[0])
    named = runs.withColumn("target", F.array_join("syllables", "|"))
    found = distance.ranked(distance.nearest(named.select("target", "syllables").distinct(), words, dist, 4.0))
    cands = named.join(found, "target").select("line.song", "line.line", "i", "t", "rank", "sim", "id")
    old = segment.generate(lines.withColumn("n", F.size("units")), cands, {"DUPLICATE": False}).collect()
    key = lambda r: (r.song, r.line, r.word, r.i, r.t, r.id, r.sim, r.score, r.filler)
    assert sorted(map(key, made), key=str) == sorted(map(key, old), key=str) and len({r.id for r in made if r.song == 1}) == sum(r.song == 1 for r in made)
    ends = {(r.song, r.line): len(r.units) for r in lines.collect()}
    for (song, line), n in ((k, n) for k, n in ends.items() if n):
        spans = sorted((r.i, r.t) for r in made if (r.song, r.line) == (song, line))
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n


def test_weights_change_the_choice(spark):
    """Two words equally far: the weights decide, on either end; weights that are not valid count as none."""
    from pyspark.sql import functions as F

    from hibiki.operators import distance, lattice

    words = spark.createDataFrame([("1", 2, 0, ["カ", "コ"], 0), ("2", 2, 1, ["コ", "カ"], 0)], "id string, n_units int, seq long, units array<string>, vcost int")
    dist = distance.unit_matrix(spark)
    rows = [("front", [9.0, 1.0]), ("back", [1.0, 9.0]), ("none", None), ("short", [1.0]), ("minus", [-1.0, 2.0])]
    targets = spark.createDataFrame([(n, ["カ", "カ"], w) for n, w in rows], "target string, syllables array<string>, w array<double>")
    got = {r.target: r.id for r in lattice.nearest(targets, words, dist, 0.0, 1, F.col("w")).collect()}
    assert got == {"front": "1", "back": "2", "none": "1", "short": "1", "minus": "1"}
    lines = targets.select(F.xxhash64("target").alias("song"), F.lit(0).cast("long").alias("line"), F.col("syllables").alias("units"), F.col("w").alias("weights"), F.array(F.lit("a"), F.lit("b")).alias("surfaces"), F.col("target"))
    made = {r.song: r for r in lattice.generate(lines, words, dist, {"DUPLICATE": False}).collect()}
    by = {r.target: made[r.song] for r in lines.select("target", "song").collect()}
    assert {n: r.id for n, r in by.items()} == got and by["front"].original_surface == "ab" and by["back"].originalkana == "カカ"
