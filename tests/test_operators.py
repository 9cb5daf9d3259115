"""Filters, word lists, distances, token repair, alignment and segmentation."""

import itertools

import pytest
from pyspark.sql import functions as F

from hibiki.functions import kana
from hibiki.operators import align, distance, segment, tokens
from hibiki.plans import where
from hibiki.sources import wordlist

ROWS = [(1, "animal", "物理"), (2, "object", "数学"), (3, "animal", None)]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", [1, 2, 3]),
        ("pos = animal", [1, 3]),
        ("pos != animal", [2]),
        ("field ~= 学", [2]),
        ("field !~= 学", [1, 3]),
        ("pos = object or pos = animal and field ~= 物", [1]),
        ("pos = object or ( pos = animal and field ~= 物 )", [1, 2]),
        ("pos=animal", [1, 3]),
        ("nothing = 1", []),
        ("pos =", []),
        ("pos", []),
    ],
)
def test_where(spark, query, want):
    df = spark.createDataFrame(ROWS, "id int, pos string, field string")
    assert sorted(r.id for r in where.where(df, query).collect()) == want


@pytest.mark.parametrize("query", ["pos = a and", "( pos = a", "pos = a )"])
def test_where_errors(query):
    with pytest.raises(ValueError):
        where.parse(query)


def test_references():
    assert where.references("a = 1 and ( b ~= 2 or a != 3 )") == ["a", "b"]


def test_tidy_and_plain(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,original,surface,status\r\n1 , Japan,ニホン , current\n2,Old,x\n\n3,France,フランス,current,extra\n", encoding="utf-8")
    rows = wordlist.read_tidy(spark, str(tmp_path / "t.csv"), "status = current").sort("seq").collect()
    assert [(r.id, r.original, r.surface) for r in rows] == [("1", "Japan", "ニホン"), ("3", "France", "フランス")]
    (tmp_path / "p.txt").write_text("# comment\nネコ\n犬,イヌ,ケン # two\n​,x\n", encoding="utf-8")
    got = wordlist.read_plain(spark, str(tmp_path / "p.txt")).sort("id", "seq").collect()
    assert [(r.id, r.original, r.surface, r.pronunciation) for r in got] == [("0", "ネコ", "ネコ", "ネコ"), ("1", "犬", "犬", "イヌ"), ("1", "犬", "犬", "ケン ")]


def test_words(spark):
    df = spark.createDataFrame([("1", "カンコ", "カンコ", None), ("2", "山", "NA", "ヤマ"), ("3", "x", "、", "")], "id string, surface string, pronunciation string, original string").select("id", F.when(F.col("id") == "2", F.col("original")).otherwise(F.col("surface")).alias("surface"), "pronunciation")
    got = wordlist.words(df).sort("id", "ordinal").collect()
    assert [(r.id, r.units, r.vcost) for r in got] == [("1", ["カ", "ン", "コ"], 0), ("1", ["カー", "コ"], 1), ("1", ["カ", "コ"], 1), ("2", ["ヤ", "マ"], 0)]
    assert {r.n_units for r in wordlist.words(df, max_units=2).collect()} == {2}


def naive_nearest(targets, words, dist, cost):
    """The best way of each word, later ways winning ties, buckets in rising order."""
    out = {}
    for name, ways in targets.items():
        for n, seq, wid, units, vcost in sorted(words, key=lambda w: (w[0], w[1])):
            best = min((sum(dist[a, b] for a, b in zip(u, units)) + (c + vcost) * cost for u, c in ways if len(u) == n), default=None)
            if best is not None and (name, wid) not in out or best is not None and best <= out[name, wid][0]:
                out[name, wid] = (best, n, seq)
    return out


def test_nearest_against_naive(spark):
    names = ["ネコ", "イヌ", "カード", "タイヨウ", "カンナ", "カッタ", "ネッコ", "ネコー", "カコ", "コカ"]
    df = spark.createDataFrame([(i, str(i % 6), w) for i, w in enumerate(names)], "r int, id string, s string")
    words = df.select("r", "id", F.posexplode(kana.ways(F.col("s"))).alias("k", "v")).select("id", F.size("v.units").alias("n_units"), (F.col("r") * 100 + F.col("k")).cast("long").alias("seq"), F.col("v.units").alias("units"), F.col("v.vcost").alias("vcost"))
    targets = spark.createDataFrame([(w, s) for w, s in (("ネコ", ["ネ", "コ"]), ("カンナ", ["カン", "ナ"]), ("カッタ", ["カッ", "タ"]), ("ネ", ["ネ"]))], "target string, syllables array<string>")
    m = distance.unit_matrix(spark)
    d = {(r.u1, r.u2): r.dist for r in m.collect()}
    got = {(r.target, r.id): (r.sim, r.n_units, r.seq) for r in distance.nearest(targets, words, m, 4.0).collect()}
    ways = {r.target: [(v["units"], v["vcost"]) for v in r.v] for r in targets.select("target", kana.variations(F.col("syllables")).alias("v")).collect()}
    assert got == naive_nearest(ways, [(r.n_units, r.seq, r.id, r.units, r.vcost) for r in words.collect()], d, 4.0)
    ranks = distance.ranked(distance.nearest(targets, words, m)).collect()
    for t in {r.target for r in ranks}:
        mine = sorted((r for r in ranks if r.target == t), key=lambda r: r["rank"])
        assert [r.sim for r in mine] == sorted(r.sim for r in mine) and [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_rewards(spark):
    m = distance.unit_matrix(spark).where("u1 IN ('カ', 'ン', 'キ') AND u2 IN ('カ', 'ン', 'サ')")
    before = {(r.u1, r.u2): r.dist for r in m.withColumn("dist", F.lit(8.0)).collect()}
    after = {(r.u1, r.u2): r.dist for r in distance.rewarded(m.withColumn("dist", F.lit(8.0)), {"SAME_VOWEL_REWARD": 0.5, "SAME_HATSUON_REWARD": 0.25, "SAME_BAR_REWARD": 0.0}).collect()}
    assert before["カ", "サ"] == 8.0 and after["カ", "サ"] == 4.0 and after["ン", "ン"] == 1.0 and after["キ", "カ"] == 8.0


def test_weights(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (1, [-1.0, 3.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0])], "i int, w array<double>")
    got = [r.o for r in df.select("i", distance.normalized_weights(F.col("w"), F.lit(2)).alias("o")).sort("i").collect()]
    assert got == [[0.5, 1.5], None, None, None, None, None, None]
    ex = spark.range(1).select(distance.expanded_weights(F.expr("array(0, 0, 1)"), F.expr("array(5, 7)")).alias("a"), distance.expanded_weights(F.expr("array(0, 2)"), F.expr("array(5, 7)")).alias("b")).first()
    assert ex.a == [5, 5, 7] and ex.b is None


def test_small_functions(spark):
    r = spark.range(1).select(distance.argsort(F.expr("array(3, 1, 3, 1)")).alias("s"), distance.argmin(F.expr("array(3, 1, 1)")).alias("m"), distance.product(F.expr("array(array('a', 'b'), array('x', 'y'))")).alias("p"), distance.product(F.expr("cast(array() as array<array<string>>)")).alias("e")).first()
    assert r.s == [1, 3, 0, 2] and r.m == 1 and r.p == [["a", "x"], ["a", "y"], ["b", "x"], ["b", "y"]] and r.e == []


def token(surface, reading, pos="名詞", ruby=False, detail="一般"):
    names = [f.split(":")[0] for f in tokens.TOKEN[7:-1].split(",")]
    values = {"surface_form": surface, "pronunciation": reading, "pos": pos, "pos_detail_1": detail, "ruby": ruby, "word_position": 1, "phrase": 0}
    return tuple(values.get(n, "*") for n in names)


def repaired(spark, repair, *toks):
    df = spark.createDataFrame([([*toks],)], f"tokens array<{tokens.TOKEN}>")
    return [(t.surface_form, t.pronunciation, t.pos) for t in df.select(repair(F.col("tokens")).alias("t")).first().t]


def test_repairs(spark):
    assert repaired(spark, tokens.merge_bar, token("カ", "カ"), token("ー", "ー"), token("ー", "ー"), token("ー", "ー", ruby=True)) == [("カー", "カー", "名詞"), ("ーー", "ーー", "名詞"), ("ー", "ー", "名詞")]
    assert repaired(spark, tokens.merge_small_kana, token("シ", "シ"), token("ェ", "ェ"), token("ァ", "ァ")) == [("シェ", "シェ", "名詞")]
    assert repaired(spark, tokens.digit_reading, token("7", "*"), token("12", "*"), token("7", "x", ruby=True)) == [("7", "ナナ", "名詞"), ("12", "*", "名詞"), ("7", "x", "名詞")]
    assert repaired(spark, tokens.kana_surface, token("ひと", "*", "記号")) == [("ひと", "ヒト", "名詞")]
    assert repaired(spark, tokens.unknown_sahen, token("x", "", detail="サ変接続")) == [("x", "", "記号")]
    assert repaired(spark, tokens.english_reading, token("love", "*"), token("love", "アイ", ruby=True)) == [("love", "ラヴ", "名詞"), ("love", "アイ", "名詞")]
    assert repaired(spark, tokens.kanji_reading, token("山川", "*"), token("山x", "*")) == [("山川", "サンカワ", "名詞"), ("山x", "*", "名詞")]
    assert repaired(spark, tokens.absorb_tokens, token("a", "シ"), token("b", "ェァ"), token("c", "ッ")) == [("a", "シ", "名詞"), ("b", "ェア", "名詞"), ("c", "ッ", "名詞")]
    assert repaired(spark, tokens.format_tokens) == []


def test_balanced_agrees(spark):
    cases = [("山川", "ヤマカワ"), ("abc", "x"), ("ab", "xyz"), ("", "x"), ("x", ""), ("abcde", "xy")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = [[tuple(x) for x in r.o] for r in df.select("i", tokens.balanced(F.col("a"), F.col("b")).alias("o")).sort("i").collect()]
    assert got == [[(p.surface, p.reading, p.inner) for p in align.balanced(a, b)] for a, b in cases]


def test_alignment(spark):
    assert align.allocate_kana(align.runs("食べる"), "タベル")[0].reading == "タ"
    assert align.allocate_kanji("東京", "トウキョウ") == [["東", "トウ"], ["京", "キョウ"]]
    units = align.line_units([{"surface_form": "山に", "pronunciation": "ヤマニ", "pos": "名詞", "phrase": 0}, {"surface_form": "。", "pronunciation": "。", "pos": "記号", "phrase": 0}])
    assert [u["pronunciation"] for u in units] == ["ヤ", "マ", "ニ"] and units[0]["surface_form"] == "山" and units[1]["surface_form"] == "" and units[2]["surface_form"] == "に。"
    assert align.line_units([]) == [] and align.line_units([{"surface_form": "", "pronunciation": None, "pos": "", "phrase": 0}]) == []


def covers(n, breaks, sims, p):
    """Every cover's score, by brute force."""
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            points = [0, *cuts, n]
            total = 0.0
            for i, t in zip(points, points[1:]):
                options = [segment.FILLER] if t - i == 1 else []
                if (i, t) in sims:
                    options.append(sims[i, t] - p["SAME_PHRASE_BREAK_REWARD"] if t in breaks else sims[i, t] + (p["MID_PHRASE_BREAK_PENALTY"] if t != n else 0))
                if not options:
                    break
                total += min(options) + p["WORD_NUMBER_PENALTY"]
            else:
                yield total


@pytest.mark.parametrize("sims", [{}, {(0, 2): 5.0, (2, 4): 7.0, (0, 4): 30.0, (1, 3): 1.0}, {(0, 1): 3.0, (1, 4): 2.0}])
def test_cover(spark, sims):
    p = segment.DEFAULTS | {"MID_PHRASE_BREAK_PENALTY": 4.0, "SAME_PHRASE_BREAK_REWARD": 2.0}
    entries = ", ".join(f"{i * 65536 + t}, double({d})" for (i, t), d in sims.items())
    costs = F.expr(f"map({entries})") if sims else F.expr("cast(map() as map<int,double>)")
    words = spark.range(1).select(segment.cover(F.lit(4), F.expr("array(0, 2)"), costs, 4, p).alias("w")).first().w
    assert [w.i for w in words] == [0, *(w.t for w in words[:-1])] and words[-1].t == 4
    assert sum(w.score + p["WORD_NUMBER_PENALTY"] for w in words) == min(covers(4, {0, 2}, sims, p))
    path = segment.best_path(4, {0, 2}, {k: [(d, str(k))] for k, d in sims.items()}, set(), p)
    assert [(w["i"], w["t"]) for w in path[1]] == [(w.i, w.t) for w in words]


def test_generate(spark):
    lines = spark.createDataFrame([(1, 0, 2, [0]), (1, 1, 2, [0]), (2, 0, 0, [])], "song long, line long, n int, breaks array<int>")
    cands = spark.createDataFrame([(1, k, 0, 2, r, float(r), i) for k in (0, 1) for r, i in ((1, "a"), (2, "b"))], "song long, line long, i int, t int, rank int, sim double, id string")
    got = sorted((r.line, r.id) for r in segment.generate(lines, cands, {"DUPLICATE": False}).collect())
    assert got == [(0, "a"), (1, "b")]
    pinned = spark.createDataFrame([(1, 0, 0, 1, "b", 0.0)], "song long, line long, i int, t int, id string, sim double")
    rows = segment.generate(lines, cands, {"DUPLICATE": False}, pinned).sort("line", "word").collect()
    assert [(r.line, r.i, r.t, r.id, r.filler) for r in rows] == [(0, 0, 1, "b", False), (0, 1, 2, None, True), (1, 0, 2, "a", False)]
