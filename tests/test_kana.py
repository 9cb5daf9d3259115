"""Kana functions against worked examples and plain-Python models."""

import re

import pytest
from pyspark.sql import functions as F

from hibiki.functions import english, kana, lexicon, ruby


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", fn(F.col("s")).alias("o")).sort("i").select("o").collect()]


def test_lexicon_sizes():
    assert len(lexicon.phonons()) == 190 and len(lexicon.units()) == 377 and len(lexicon.romaji()) == 228
    assert len({v for _, v in lexicon.units().values()}) == 159 and len({c for c, _ in lexicon.units().values()}) == 129


def test_romaji_keys_are_prefix_free():
    keys = sorted(lexicon.romaji())
    assert not [(a, b) for a, b in zip(keys, keys[1:]) if b.startswith(a)]


def test_default_matrices_are_symmetric_and_bounded():
    for m in (lexicon.vowel_matrix(), lexicon.consonant_matrix()):
        assert all(d == m[b, a] and 0 <= d <= 80 for (a, b), d in m.items()) and all(m[a, a] == 0 for a, _ in m)


SYLLABLES = {"カンコ": ["カン", "コ"], "ネッコ": ["ネッ", "コ"], "タイヨウ": ["タ", "イ", "ヨウ"], "アーン": ["アーン"], "キャット": ["キャッ", "ト"], "ンー": ["ンー"], "トウェ": ["ト", "ウェ"], "xカ": ["カ"], "": []}


def test_syllables(spark):
    assert apply(spark, SYLLABLES, kana.syllable_split) == list(SYLLABLES.values())


VARIANTS = {
    "ア": [(["ア"], 0)], "ッ": [(["ッ"], 0), ([], 1)], "ンー": [(["ン", "ン"], 1), (["ン"], 1), ([], 2)], "ンッ": [(["ン", "ッ"], 0), (["ン"], 1), (["ッ"], 1), ([], 2)],
    "カーン": [(["カー", "ン"], 0), (["カー"], 1)], "カンッ": [(["カ", "ン", "ッ"], 0), (["カ", "ン"], 1), (["カー", "ッ"], 1), (["カー"], 2), (["カ", "ッ"], 1)],
    "カーッ": [(["カー", "ッ"], 0), (["カー"], 1)], "カー": [(["カー"], 0)], "カッ": [(["カ", "ッ"], 0), (["カ"], 1), (["カー"], 1)],
    "カン": [(["カ", "ン"], 0), (["カー"], 1), (["カ"], 1)], "トウ": [(["ト", "ウ"], 0), (["トー"], 0)], "キャ": [(["キャ"], 0)],
}


def test_variants(spark):
    got = apply(spark, VARIANTS, kana.syllable_variants)
    assert [[(v["units"], v["cost"]) for v in x] for x in got] == list(VARIANTS.values())


def model_variations(syllables):
    out = [([], 0, [])]
    for i, s in enumerate(syllables):
        out = [(u + w, c + d, k + [i] * len(w)) for u, c, k in out for w, d in VARIANTS[s]]
    return [x for x in out if x[0]]


@pytest.mark.parametrize("limit", [None, 0, 1, 2, 3, 5])
def test_variations_and_limit(spark, limit):
    lists = [["カン", "トウ"], ["ッ", "ンッ"], ["ア", "カッ", "カンッ"], ["ッ"], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, s array<string>")
    got = [r.v for r in df.select("i", kana.variations(F.col("s"), limit).alias("v")).sort("i").collect()]
    want = [[x for x in model_variations(s) if limit is None or len(x[0]) <= limit] if s else [] for s in lists]
    assert [[(v["units"], v["vcost"], v["src"]) for v in x] for x in got] == want


def test_normalisation(spark):
    assert apply(spark, ["カァ", "カァァ", "キィィ", "ーァ", "カィ"], kana.small_vowel_to_bar) == ["カー", "カー", "キー", "ー", "カィ"]
    assert apply(spark, ["ファ", "カャ", "ァア", "トゥ", "シェ"], kana.small_vowel_to_large) == ["ファ", "カヤ", "アア", "トゥ", "シェ"]
    assert apply(spark, ["ーカーー", "カッーッ", "ッッ"], kana.dedup_bar_sokuon) == ["カー", "カッ", ""]
    assert apply(spark, ["ハァ", "ウッセェ", "リィ", "シェ", "スゥィ", "きゃ", "ゃ", ""], kana.absorb_small_kana) == ["ハア", "ウッセエ", "リイ", "シェ", "スウィ", "きゃ", "や", ""]
    assert apply(spark, ["カー", "ンー", "ッー", "ヲー"], kana.bar_to_vowel) == ["カア", "ンン", "ッッ", "ヲヲ"]


def test_classes(spark):
    assert apply(spark, ["カ", "キャ", "カーー", "ー", "ン", "ヲ", ""], kana.kana_vowel) == ["ア", "ア", "ア", "ー", "sp", "ヲ", ""]
    assert apply(spark, ["カ", "ヂ", "ア", "ン", "ヴ", "ヲ", ""], kana.kana_consonant) == ["k", "z", "", "sp", "b", "", ""]


def test_signs_and_width(spark):
    assert apply(spark, ["Ａ！ ｂ_・「x」。、　y", None], kana.remove_sign) == ["Ab_xy", None]
    assert apply(spark, ["ひらがな", "ゖ", "abc"], kana.hira_to_kata) == ["ヒラガナ", "ヶ", "abc"]


@pytest.mark.parametrize(("word", "want"), [("kitte", "キッテ"), ("shinbun", "シンブン"), ("hon", "ホン"), ("matcha", "マtチャ"), ("", ""), ("1a", "1ア"), ("nn", "ン"), ("HON", "ホN")])
def test_roman_to_kana(word, want):
    assert english.roman_to_kana(word) == want


def test_roman_to_kana_agrees_with_pieces():
    pattern = re.compile(lexicon.romaji_pattern())
    for word in ("adocobo", "aianou", "kyaku", "fyunnga"):
        assert pattern.sub(lambda m: lexicon.romaji()[m[0]], word) == english.roman_to_kana(word)


def test_format_kana(spark):
    assert apply(spark, ["love", "カタカナ、と ひらがな", "ァ", None], english.format_kana) == ["ラヴ", "カタカナトヒラガナ", "ア", None]


RUBY = [
    ("｜東京《とうきょう》へ", "東京へ", [(0, 2, "トウキョウ")]),
    ("a\\｜b《c》", "a｜b《c》", []),
    ("｜a｜b《よみ》", "｜ab", [(2, 3, "ヨミ")]),
    ("｜《x》", "｜《x》", []),
    ("|x《》", "|x《》", []),
    ("｜a\nb《c》", "｜a\nb《c》", []),
    ("𩸽｜𩸽《ほっけ》", "𩸽𩸽", [(1, 2, "ホッケ")]),
    ("\\", "\\", []),
    ("", "", []),
]


def test_ruby(spark):
    got = apply(spark, [t for t, _, _ in RUBY], ruby.ruby_parse)
    assert [(r["plain"], [tuple(a) for a in r["annotations"]]) for r in got] == [(p, a) for _, p, a in RUBY]
    assert apply(spark, [t for t, _, _ in RUBY], ruby.has_ruby) == [bool(a) for _, _, a in RUBY]
    assert [[p["type"] for p in x] for x in apply(spark, ["", "｜a《b》", "x｜a《b》y"], ruby.ruby_split)] == [["chunk"], ["ruby"], ["chunk", "ruby", "chunk"]]
