"""Stateful generation over a stream, and the SQL names."""

from hibiki.functions.sql import register_all
from hibiki.streaming.generate import generate_stream

SCHEMA = "song long, line long, n int, breaks array<int>, spans array<struct<i:int,t:int,c:array<struct<sim:double,id:string>>>>"


def test_stream_keeps_used_words(spark, tmp_path):
    span = [(0, 1, [(1.0, "a"), (2.0, "b")])]
    for k in range(2):
        spark.createDataFrame([(1, k, 1, [0], span)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = generate_stream(stream, {"DUPLICATE": False}).writeStream.format("memory").queryName("made").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.sql("SELECT id FROM made").collect()) == ["a", "b"]


def test_sql_names(spark):
    register_all(spark)
    r = spark.sql("SELECT romaji_kana('shinbun') AS a, ruby_parsed('｜x《y》').plain AS b").first()
    assert (r.a, r.b) == ("シンブン", "x")


def stream_words(spark):
    from hibiki.operators import distance, lattice

    said = ["カキ", "クケ", "サキ", "トモ", "ナカ", "モリ", "カ", "キ", "サ"]
    rows = [(f"w{i}", len(w), i, list(w), 0, w) for i, w in enumerate(said)]
    words = spark.createDataFrame(rows, "id string, n_units int, seq long, units array<string>, vcost int, surface string")
    return lattice.index(words, distance.unit_matrix(spark), 2.0)


LINES = [(1, 0, "カキクケ"), (1, 1, "サキトモ"), (1, 2, "カキモリ"), (1, 3, "カキサ"), (2, 0, "カキカキ"), (2, 1, ""), (2, 2, None), (2, 3, "モリノナカ")]


def test_raw_lines_as_a_stream(spark, tmp_path):
    """Lines in three batches, with a restart between them, equal the batch job; callbacks see every whole line."""
    from hibiki.operators import lattice
    from hibiki.sources import text
    from hibiki.streaming.generate import STORE, callbacks, generate_lines

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = stream_words(spark)
    pin = [(0, 2, "pin", 0.5, "ソラ", ["ソ", "ラ"], "ソラ", "空")]
    kind = f"song long, line long, text string, weights array<double>, locks array<{lattice.LOCK}>"
    rows = [(s, n, t, [1.0, 2.0, 1.0, 1.0] if n == 1 else None, pin if (s, n) == (1, 2) else None) for s, n, t in LINES]
    for again in (False, True):
        at = tmp_path / str(again)
        p = {"DUPLICATE": again, "VARIATION_COST": 2.0}
        told = []
        for k in range(3):
            spark.createDataFrame([r for r in rows if r[1] in ((0,), (1, 2), (3,))[k]], kind).coalesce(1).write.mode("append").parquet(str(at / "in"))
            stream = spark.readStream.schema(kind).parquet(str(at / "in"))
            out = generate_lines(stream, found, p)
            query = out.writeStream.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(at / "out"))).option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        want = lattice.generate(text.lyrics(spark.createDataFrame(rows, kind)), found, parameters=p)
        key = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
        got = spark.read.parquet(str(at / "out"))
        assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)
        ids = [r.id for r in got.where("song = 1 AND NOT filler").collect()]
        assert "pin" in ids and (again or len(ids) == len(set(ids)))
        log = tmp_path / f"log{again}"
        log.mkdir()

        def each_line(song, line, words, log=log):
            (log / f"{song}-{line}").write_text("|".join(w["surface"] for w in sorted(words, key=lambda w: w["word"])))

        callbacks(each_line, lambda df, i: told.append((df.count(), i)))(want, 0)
        assert told == [(want.count(), 0)] and {f.name for f in log.iterdir()} == {f"{s}-{n}" for s, n, t in LINES if t}
        assert (log / "1-2").read_text().startswith("ソラ|")
