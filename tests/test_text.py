"""From text to tokens: ruby spans, tokenizers, data files."""

import json

import pytest
from pyspark.sql import functions as F

from hibiki.functions import english, kana, lexicon
from hibiki.operators import align, distance, lattice, tokens
from hibiki.sources import dictionary, text, wordlist


def test_ruby_spans_keep_their_reading(spark):
    rows = spark.createDataFrame([(0, "｜大空《うみ》を見る"), (1, "don't"), (2, None), (3, "")], "i int, x string")
    got = {r.i: r.t for r in rows.select("i", text.tokenize_together(F.col("x")).alias("t")).collect()}
    assert [(t.surface_form, t.pronunciation, t.ruby) for t in got[0]][:1] == [("大空", "ウミ", True)]
    assert [t.word_position for t in got[0]] == [1, 3, 4, 5] and got[2] is None and got[3] == []
    plain = rows.where("i = 1").select(text.tokenized(F.col("x")).alias("t")).first().t
    assert "".join(t.surface_form for t in plain) == "donAPOSTROPHEt"


def test_english_lines(spark):
    """Latin words of unknown reading get theirs, apostrophes come back, other tokens stay."""
    rows = spark.createDataFrame([(0, "love it's neko 3"), (1, None), (2, "")], "i int, x string")
    got = {r.i: r.t for r in rows.select("i", text.english_line(F.col("x"), text.Words).alias("t")).collect()}
    assert [(t.surface_form, t.pronunciation) for t in got[0] if t.surface_form != " "] == [("love", "ラヴ"), ("it's", english.to_kana("it's")), ("neko", "ネコ"), ("3", "3")]
    assert got[1] is None and got[2] == [] and isinstance(text.Words(), text.Tokenizer) and text.Words().get_yomi(["x"]) == ["x"]


def test_dictionaries_as_tables(spark, tmp_path):
    """Lookups by joins equal those in literal maps, with dictionaries read from files."""
    (tmp_path / "e.json").write_text(json.dumps({f"W{i}": f"カ{i}" for i in range(3_000)} | lexicon.ENGLISH, ensure_ascii=False))
    (tmp_path / "k.json").write_text(json.dumps({k: v for k, v in lexicon.KANJI.items()} | {"空白": []}, ensure_ascii=False))
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["love", "Love", "w2999", "none", None, "", "love"])], "i int, word string")
    got = {r.i: r.out for r in dictionary.looked_up(words, "word", dictionary.read_english(spark, str(tmp_path / "e.json")), "out").collect()}
    assert got == {0: "ラヴ", 1: "ラヴ", 2: "カ2999", 3: "none", 4: None, 5: "", 6: "ラヴ"}
    assert {r.i: r.out for r in words.select("i", english.english_lookup(F.col("word")).alias("out")).where("i <> 2").collect()} == {k: v for k, v in got.items() if k != 2}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["山川x東", "xyz", "", None, "日日"])], "i int, text string")
    table = dictionary.read_kanji(spark, str(tmp_path / "k.json"))
    mine = {r.i: r.out for r in dictionary.kanji_texts(texts, "i", "text", table, "out").collect()}
    assert mine == {r.i: r.out for r in texts.select("i", tokens.kanji_to_kana(F.col("text")).alias("out")).collect()} and mine[0] == "サンカワヒガシ"


def test_data_files(spark, tmp_path):
    with pytest.raises(ValueError):
        text.read_sample(spark, "rivers", str(tmp_path))
    with pytest.raises(ValueError):
        text.read_data(spark, str(tmp_path), "double")
    (tmp_path / "nations.csv").write_text("id,original,surface,status\n1,a,アイ,current\n2,b,ウエ,old")
    assert [r.surface for r in text.read_sample(spark, "nations", str(tmp_path), "status = old").collect()] == ["ウエ"]
    for n in [*text.FILES.values(), *text.MATRICES["monotie"]]:
        (tmp_path / n).write_text(json.dumps({"a": {"b": 2}}))
    assert text.cells(text.read_data(spark, str(tmp_path), "monotie")["vowel_similarity"]) == {("a", "b"): 2.0}


def test_text_to_words(spark):
    rows = spark.createDataFrame([("1", "ネコ", "ネコ", 0), ("2", "イヌ", "イヌ", 1)], "id string, original string, surface string, seq long")
    words = wordlist.words(rows, order=("seq",))
    lines = text.lyrics(spark.createDataFrame([(1, 0, "ねこ"), (1, 1, "｜犬《いぬ》")], "song long, line long, text string"))
    got = lattice.generate(lines, words, distance.unit_matrix(spark), {"DUPLICATE": False}).sort("line").collect()
    assert [(r.id, r.surface, r.original_surface, r.originalkana) for r in got] == [("1", "ネコ", "ねこ", "ネコ"), ("2", "イヌ", "犬", "イヌ")]
    c = kana.KanaConverter
    assert spark.range(1).select(c.is_same_vowel(F.lit("カ"), F.lit("サ")).alias("a"), kana.format_text(F.lit("x")).alias("b"), c.separate(F.lit("カン")).alias("c")).first() == (True, None, ["カン"])


def test_phonons(spark):
    """Each phonon is one sound: a consonant with its vowel, short or long, ン or ッ."""
    cases = {"カンコー": ["カ", "ン", "コー"], "シャッター": ["シャ", "ッ", "ター"], "アイ": ["ア", "イ"], "ティx": ["ティ"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.o for r in df.select("s", kana.phonon_split(F.col("s")).alias("o")).collect()} == cases


def test_allocations_in_columns(spark):
    """Readings dealt to runs and to kanji; null counts as empty."""
    rows = spark.createDataFrame([("食べる", "タベル"), ("ｘカ", "エカ"), ("アあ", "アア"), (None, "ア"), ("山", None)], "s string, r string")
    kana_ = [[(p.surface, p.reading, p.type) for p in r.o] for r in rows.select(align.kana_pairs(F.col("s"), F.col("r")).alias("o")).collect()]
    assert kana_ == [[("食", "タ", "nonkana"), ("べる", "ベル", "hira")], [("ｘ", "エ", "nonkana"), ("カ", "カ", "kata")], [("ア", "ア", "kata"), ("あ", "ア", "hira")], [], []]
    kanji = spark.createDataFrame([("東京", "トウキョウ"), ("東x京", "トウエキョウ"), ("xy", "ア"), ("山川", "ヤマ"), (None, "ア")], "s string, r string")
    pairs = [[(p.surface, p.reading) for p in r.o] for r in kanji.select(align.kanji_pairs(F.col("s"), F.col("r")).alias("o")).collect()]
    assert pairs[0] == [("東", "トウ"), ("京", "キョウ")] and pairs[1] == [("東", "トウ"), ("x", "エ"), ("京", "キョウ")] and pairs[2] == [("xy", "ア")] and pairs[3] == [("山川", "ヤマ")]


def test_characters_of_a_line(spark):
    line = [("山に", "ヤマニ", "名詞"), ("。", "。", "記号"), ("きゃ", "キャ", "名詞")]
    df = spark.createDataFrame([([(s, r, p, 0) for s, r, p in line],)], "t array<struct<surface_form:string,pronunciation:string,pos:string,phrase:int>>")
    got = df.select(align.line_pieces(F.col("t")).alias("o")).first().o
    assert [(p.reading, p.token, p.subword, p.char_index, p.inner) for p in got] == [("ヤ", 0, 0, 0, 0), ("マ", 0, 0, 0, 1), ("ニ", 0, 1, 1, 0), ("キ", 2, 3, 3, 0), ("ャ", 2, 3, 4, 0)]
    assert got[2].surface == "に。"
