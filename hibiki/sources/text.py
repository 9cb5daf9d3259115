"""From lyric text to tokens and units: tokenizers, ruby spans with fixed readings, data files.

A tokenizer is any object with the two methods of `Tokenizer`; it is made once in each Python
worker by a function without arguments, so that it need not be sent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import APOSTROPHE, first_wide_letter, to_kana
from ..functions.lexicon import ENGLISH
from ..functions.ruby import pieces
from ..operators import align, segment
from ..operators.tokens import TOKEN, format_tokens
from ..plans.rows import mapped
from ..plans.store import stored
from . import dictionary as dictionaries
from .wordlist import read_tidy

FIELDS = [f.split(":")[0] for f in TOKEN[7:-1].split(",")]
TOKENS = f"array<{TOKEN}>"
_WORDS = re.compile("[A-Za-z']+|.", re.S)
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'")


@runtime_checkable
class Tokenizer(Protocol):
    def tokenize(self, texts: list[str]) -> list[list[dict]]:
        """Each text's tokens, with the fields of TOKEN that it knows."""

    def get_yomi(self, texts: list[str]) -> list[str]:
        """Each text's reading."""


class Characters:
    """Every character a noun that reads as it is written: for tests and for text in kana."""

    def tokenize(self, texts: list[str]) -> list[list[dict]]:
        return [[token(c, c, word_position=i + 1) for i, c in enumerate(t)] for t in texts]

    def get_yomi(self, texts: list[str]) -> list[str]:
        return list(texts)


def token(surface: str, reading: str, **more) -> dict:
    """A noun with a reading."""
    plain = dict.fromkeys(FIELDS, "*") | {"surface_form": surface, "basic_form": surface, "reading": reading, "pronunciation": reading, "pos": "名詞", "pos_detail_1": "一般", "word_position": 1, "phrase": None, "ruby": None}
    return plain | more


def merge_ruby_tokens(plan: list[dict], chunks: list[list[dict]]) -> list[dict]:
    """One line's tokens: those of its chunks in order, and for each ruby span one noun whose reading is fixed. Lines with a span have their word positions counted anew, from 1 in code points."""
    rest, out = iter(chunks), []
    for part in plan:
        out += [token(part["surface"], part["reading"], ruby=True)] if part["type"] == "ruby" else next(rest, [])
    if any(part["type"] == "ruby" for part in plan):
        at = 1
        for i, t in enumerate(out):
            out[i] = t | {"word_position": at}
            at += len(t.get("surface_form") or "")
    return out


def split_and_merge(texts: list[str], tokenizer: Tokenizer) -> list[list[dict]]:
    """Tokens of whole texts: apostrophes set aside, ruby spans taken out, all chunks tokenized together, spans put back."""
    plans = [pieces(t.replace("’", "'").replace("'", APOSTROPHE)) for t in texts]
    cut = tokenizer.tokenize([p["surface"] for plan in plans for p in plan if p["type"] == "chunk"])
    out, at = [], 0
    for plan in plans:
        n = sum(p["type"] == "chunk" for p in plan)
        out.append(merge_ruby_tokens(plan, cut[at : at + n]))
        at += n
    return out


def tokenized(text: Column, make: Callable[[], Tokenizer] = Characters) -> Column:
    """Tokens of each text before any repair; null text gives null."""
    held: list[Tokenizer] = []

    @F.pandas_udf(TOKENS)
    def run(values: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        there = values.notna().to_numpy()
        lines = iter(split_and_merge(values[there].tolist(), held[0]))
        return pd.Series([[{k: t.get(k) for k in FIELDS} for t in next(lines)] if ok else None for ok in there], dtype=object)

    return run(text)


def with_tokens(rows: DataFrame, text: Column, make: Callable[[], Tokenizer] = Characters, out: str = "tokens") -> DataFrame:
    """rows with the tokens of each text before any repair, some rows at a time; null text gives null."""
    held: list[Tokenizer] = []

    def run(values: list) -> list:
        if not held:
            held.append(make())
        lines = iter(split_and_merge([v for v in values if v is not None], held[0]))
        return [None if v is None else next(lines) for v in values]

    return mapped(rows, out, TOKENS, run, text)


def tokenize_together(text: Column, make: Callable[[], Tokenizer] = Characters) -> Column:
    """Tokens of each text with all repairs of readings."""
    return format_tokens(tokenized(text, make))


def yomi_of(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A tokenizer's readings as a function of a column, for wordlist.words(get_yomi=...)."""
    held: list[Tokenizer] = []

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        there = values.notna().to_numpy()
        said = iter(held[0].get_yomi(values[there].tolist()))
        return pd.Series([next(said) if ok else None for ok in there], dtype=object)

    return run


def english_tokens(text: str, tokenizer: Tokenizer, dictionary: dict[str, str] = ENGLISH) -> list[dict]:
    """A text's tokens, where Latin words of unknown reading get their kana and set-aside apostrophes come back."""
    out = []
    for t in tokenizer.tokenize([text.replace("’", "'").replace("'", APOSTROPHE)])[0]:
        word = t["surface_form"]
        if word and _LATIN.issuperset(word):
            word = word.replace(APOSTROPHE, "'")
            t = t | {"surface_form": word} | ({"pronunciation": to_kana(word, dictionary)} if t["pronunciation"] == "*" else {})
        out.append(t)
    return out


def english_line(text: Column, make: Callable[[], Tokenizer] = Characters, dictionary: dict[str, str] = ENGLISH) -> Column:
    """english_tokens of each text; null text gives null."""
    held: list[Tokenizer] = []

    @F.pandas_udf(TOKENS)
    def run(values: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        return pd.Series([None if v is None else [{k: t.get(k) for k in FIELDS} for t in english_tokens(v, held[0], dictionary)] for v in values], dtype=object)

    return run(text)


def with_english_tokens(rows: DataFrame, text: Column, make: Callable[[], Tokenizer] = Characters, dictionary: dict[str, str] = ENGLISH, out: str = "tokens") -> DataFrame:
    """rows with english_tokens of each text, some rows at a time; null text gives null."""
    held: list[Tokenizer] = []

    def run(values: list) -> list:
        if not held:
            held.append(make())
        return [None if v is None else english_tokens(v, held[0], dictionary) for v in values]

    return mapped(rows, out, TOKENS, run, text)


class Words:
    """Runs of letters and apostrophes as words of unknown reading, every other character apart: for Latin text."""

    def tokenize(self, texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            line = []
            for m in _WORDS.finditer(t):
                line.append(token(m[0], "*" if _LATIN.issuperset(m[0]) else m[0], word_position=m.start() + 1))
            out.append(line)
        return out

    def get_yomi(self, texts: list[str]) -> list[str]:
        return list(texts)


def lyrics(lines: DataFrame, make: Callable[[], Tokenizer] = Characters, text_col: str = "text", english: DataFrame | None = None, kanji: DataFrame | None = None) -> DataFrame:
    """(song, line, units, surfaces, breaks, ...) of raw lines(song, line, text): what lattice.generate takes. Other columns stay; null and empty texts have no units.

    english(word, said) and kanji(kanji, readings) are dictionary tables of any length, joined on
    (song, line), which must then be distinct; without them the small ones of our own are used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # tokenizing, repair and alignment each run in Python: one is written before the next reads it
    if english is None and kanji is None:
        return from_tokens(stored(with_tokens(lines, text, make).withColumn("tokens", format_tokens(F.col("tokens"))).drop(text_col)))
    told = stored(with_tokens(lines, text, make).drop(text_col))
    surfaces = F.transform("tokens", lambda t: t["surface_form"])
    if english is not None:
        words = F.transform(surfaces, lambda s: F.upper(first_wide_letter(F.replace(s, F.lit(APOSTROPHE), F.lit("'")))))
        told = dictionaries.with_entries(told, ["song", "line"], words, english, "_english")
    if kanji is not None:
        letters = F.regexp_extract_all(F.array_join(surfaces, ""), F.lit("(?s)."), 0)
        told = dictionaries.with_entries(told, ["song", "line"], letters, kanji.select(F.col("kanji").alias("word"), F.col("readings").alias("said")), "_kanji")
    own = {k: F.col(f"_{k}") for k, v in (("english", english), ("kanji", kanji)) if v is not None}
    ready = stored(told.withColumn("tokens", format_tokens(F.col("tokens"), **own)))
    return from_tokens(ready, kanji=own.get("kanji")).drop("_english", "_kanji")


def from_tokens(lines: DataFrame, tokens_col: str = "tokens", kanji: Column | None = None) -> DataFrame:
    """lyrics of lines whose tokens are made already; kanji: a map column of each line's kanji and their readings."""
    each = lambda f: F.transform("u", lambda x: x[f])
    # written once: the alignment runs in Python and is read three times, also inside a lambda
    aligned = align.align_line(F.col(tokens_col)) if kanji is None else align.align_line(F.col(tokens_col), kanji)
    named = stored(lines.withColumn("u", aligned).drop(tokens_col))
    return named.withColumn("units", each("pronunciation")).withColumn("surfaces", each("surface_form")).withColumn("breaks", segment.phrase_breaks(each("phrase"))).drop("u")


#: Names of the sample word lists, of the dictionary files, and of the distance files of each kind.
SAMPLES = ("nations", "sekitsui", "stations")
FILES = {"kanji_dict": "kanjiyomi.json", "english_dict": "english-kana.json", "roman_tree": "tree_roma2kana.json", "kana2phonon": "kana2phonon.json"}
MATRICES = {"simple": ("simVowelsSimple.json", "simConsonantsSimple.json"), "monotie": ("simVowelsMonoTie.json", "simConsonantsMonoTie.json")}


def read_sample(spark: SparkSession, name: str, folder: str, where: str = "") -> DataFrame:
    """A sample word list, name.csv in a folder; another name is an error."""
    if name not in SAMPLES:
        raise ValueError(f"no sample word list {name!r}: there are {', '.join(SAMPLES)}")
    return read_tidy(spark, f"{folder.rstrip('/')}/{name}.csv", where)


def _read_json(spark: SparkSession, folder: str, names: dict[str, str]) -> dict:
    found = {r.path.rsplit("/", 1)[-1]: r.content for r in spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names.values()]).select("path", "content").collect()}
    return {k: json.loads(bytes(found[n]).decode()) for k, n in names.items()}


def _matrices(similarity: str) -> dict[str, str]:
    if similarity not in MATRICES:
        raise ValueError(f"no similarity {similarity!r}: there are {', '.join(MATRICES)}")
    return dict(zip(("vowel_similarity", "consonant_similarity"), MATRICES[similarity]))


def read_data(spark: SparkSession, folder: str, similarity: str = "simple") -> dict:
    """The dictionaries and distance tables in a folder's JSON files, through Spark's file systems; another kind of similarity is an error."""
    return _read_json(spark, folder, FILES | _matrices(similarity))


def read_distances(spark: SparkSession, folder: str, similarity: str = "simple") -> dict:
    """The two distance tables alone, which are of fixed size, unlike the dictionaries."""
    return _read_json(spark, folder, _matrices(similarity))


def cells(table: dict[str, dict[str, float]]) -> dict[tuple[str, str], float]:
    """A nested distance table as distance.matrix takes it."""
    return {(a, b): float(d) for a, row in table.items() for b, d in row.items()}
