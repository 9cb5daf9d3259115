"""The bound entry, and dictionaries as tables on the way from lines to words."""

import json

import pytest
from pyspark.sql import functions as F

from hibiki.functions import lexicon
from hibiki.operators import distance, lattice
from hibiki.sources import dictionary, text, wordlist
from hibiki.studio import Studio

LINES = [(0, 0, "love 山川 it's"), (0, 1, "ネコ xq"), (1, 0, "日々"), (1, 1, ""), (2, 0, None), (2, 1, "love love")]


def reader():
    """A maker of tokenizers for Latin words and kanji of unknown reading; local, so that workers need not import this file."""

    class Runs(text.Words):
        def tokenize(self, texts):
            return [[t | ({"pronunciation": "*", "reading": "*"} if "一" <= t["surface_form"] <= "龠" else {}) for t in line] for line in super().tokenize(texts)]

    return Runs


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in ("song", "line", "units", "surfaces", "breaks")) for r in df.collect())


def test_tables_say_what_maps_say(spark):
    """Lines and words read with dictionary tables equal those read with maps in the plan."""
    make = reader()
    songs = spark.createDataFrame(LINES, "song long, line long, text string")
    english = dictionary.english(spark, lexicon.ENGLISH | {"ZZ": "カミ"} | {f"W{i}": "カ" for i in range(3_000)})
    kanji = dictionary.kanji(spark, lexicon.KANJI | {"無": []})
    plain = rows_of(text.lyrics(songs, make))
    assert rows_of(text.lyrics(songs, make, english=english, kanji=kanji)) == plain and len(plain) == len(LINES)
    assert rows_of(text.lyrics(songs, make, english=english)) == plain == rows_of(text.lyrics(songs, make, kanji=kanji))
    given = spark.createDataFrame([("a", "love", 0), ("b", "ネコ", 1), ("c", "love it's", 2), ("d", "", 3), ("e", None, 4), ("f", "zz", 5)], "id string, surface string, seq long")
    got = [{(r.id, r.kana, tuple(r.units)) for r in wordlist.words(given, 30, order=("seq",), english=e).collect()} for e in (None, english)]
    same = [{x for x in g if x[0] != "f"} for g in got]
    assert same[0] == same[1] and {x[0] for x in same[0]} == {"a", "b", "c"}
    assert {x[1] for x in got[1] if x[0] == "f"} == {"カミ"} != {x[1] for x in got[0] if x[0] == "f"}


def test_entries_of_rows(spark):
    rows = spark.createDataFrame([(1, ["A", "A", "x"]), (2, []), (3, None), (None, ["B"])], "k int, w array<string>")
    table = spark.createDataFrame([("A", "2"), ("A", "1"), ("B", None), ("C", "9"), (None, "7")], "word string, said string")
    got = {r.k: r.m for r in dictionary.with_entries(rows, ["k"], F.col("w"), table, "m").collect()}
    assert got == {1: {"A": "1"}, 2: {}, 3: {}, None: {}}
    assert dictionary.with_entries(rows.where("false"), ["k"], F.col("w"), table, "m").count() == 0


def test_studio(spark, tmp_path):
    """Bound parts give what the parts give by hand; data come from a folder; wrong settings are errors."""
    make = reader()
    nested = lambda cells: {a: {b: float(d) for (x, b), d in cells.items() if x == a} for a, _ in cells}
    files = {"english_dict": lexicon.ENGLISH, "kanji_dict": lexicon.KANJI}
    for name, value in files.items():
        (tmp_path / text.FILES[name]).write_text(json.dumps(value, ensure_ascii=False))
    for name, value in zip(text.MATRICES["monotie"], (lexicon.vowel_matrix(), lexicon.consonant_matrix())):
        (tmp_path / name).write_text(json.dumps(nested(value), ensure_ascii=False))
    studio = Studio.from_folder(spark, str(tmp_path), make, "monotie", vowel_ratio=0.5, parameters={"VARIATION_COST": 2.0})
    assert {tuple(r) for r in studio.distances.collect()} == {tuple(r) for r in distance.unit_matrix(spark).collect()}
    given = spark.createDataFrame([("1", "ラヴ"), ("2", "ネコ"), ("3", "ヤマ"), ("4", "カワ"), ("5", "love")], "id string, surface string")
    words = studio.words(given, 30)
    found = studio.index(words)
    songs = spark.createDataFrame(LINES, "song long, line long, text string")
    made = studio.generate(songs, found, DUPLICATE=False)
    by_hand = lattice.generate(text.lyrics(songs, make), found, parameters={"VARIATION_COST": 2.0, "DUPLICATE": False})
    assert sorted(map(str, made.collect())) == sorted(map(str, by_hand.collect())) and made.count() > 4
    said = {(r.song, r.line): r.said for r in studio.song(made).collect()}
    assert said[(2, 1)].split()[0] in ("ラヴ", "love") and (1, 1) not in said
    with pytest.raises(ValueError):
        Studio(spark, parameters={"NO_SUCH": 1})
    with pytest.raises(ValueError):
        Studio(spark, vowel_ratio=1.5)
    with pytest.raises(ValueError):
        Studio.from_folder(spark, str(tmp_path), similarity="other")
