"""Alignment of surface characters with readings, and the units of a line.

The search for readings inside readings carries state from character to character, so these
run on token lists in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kana import HIRA, KATA, SYLLABLE
from ..functions.lexicon import KANJI
from ..plans.rows import mapped

_KATA = str.maketrans(HIRA, KATA)
_RUN = re.compile("(?P<kata>[ァ-ヴー]+)|(?P<hira>[ぁ-ゔー]+)|(?P<nonkana>[^ぁ-ゔァ-ヴー]+)")
_SYLLABLE = re.compile(SYLLABLE)
_KANA = re.compile("[ぁ-ゔァ-ヴー]*")
_ASCII = re.compile("[A-Za-z0-9_']+")
_SMALL = tuple("ァィゥェォヮャュョ")
UNITS = "array<struct<surface_form:string,token_index:int,phrase:int,pronunciation:string,subword:int,char_index:int,mora:int>>"


@dataclass
class Piece:
    surface: str
    reading: str
    kind: str = ""
    inner: int = 0  # place within the surface character
    token: int = 0
    phrase: int | None = None
    subword: int = 0
    char: int = 0


def runs(text: str) -> list[tuple[str, str]]:
    return [(m[0], m.lastgroup) for m in _RUN.finditer(text)]


def allocate_kana(parts: list[tuple[str, str]], reading: str) -> list[Piece]:
    """Kana runs found in the reading, first place first; what lies before a run goes to the run before it, the rest to the end."""
    out = []
    for i, (surface, kind) in enumerate(parts):
        if kind == "nonkana":
            continue
        said = surface.translate(_KATA) if kind == "hira" else surface
        at = reading.find(said)
        if at > 0:
            before, what = parts[i - 1]
            out.append(Piece(before, reading[:at], what))
            reading = reading[at:]
        out.append(Piece(surface, reading[: len(said)], kind))
        reading = reading[len(said) :]
    if parts and reading:
        surface, kind = parts[-1]
        out.append(Piece(surface if kind == "nonkana" else "", reading, kind))
    return out


def _blank_number(text: str) -> bool:
    try:
        return text.strip() == "" or float(text) == 0
    except ValueError:
        return False


def allocate_kanji(surface: str, reading: str, dictionary: dict[str, list[str]] = KANJI) -> list[list[str]]:
    """Each kanji takes its longest known reading that is still ahead; skipped characters share what lies before it."""
    out: list[list[str]] = []
    skipped = ""
    for c in surface:
        said = next((y for y in dictionary.get(c, ()) if y in reading), None)
        if said is None:
            skipped += c
            continue
        at = reading.find(said)
        gap, reading = reading[:at], reading[at + len(said) :]
        if gap and not out and not skipped:
            said = gap + said
        elif gap and (not out or not _blank_number(skipped)):
            out.append([skipped, gap])
            skipped = ""
        elif gap:
            out[-1][1] += gap
        out.append([c, said])
    if skipped and (reading or not out):
        out.append([skipped, reading])
    elif skipped:
        out[-1][0] += skipped
    elif out:
        out[-1][1] += reading
    return out


def balanced(surface: str, reading: str) -> list[Piece]:
    """The longer string dealt over the shorter's characters, one more to each of the first ones."""
    few, many = sorted((len(surface), len(reading)))
    if not few:
        return []
    base, extra = divmod(many, few)
    out, at = [], 0
    for i in range(few):
        n = base + (i < extra)
        if len(surface) <= len(reading):
            out += [Piece(surface[i], reading[at + j], inner=j) for j in range(n)]
        else:
            out.append(Piece(surface[at : at + n], reading[i]))
        at += n
    return out


def _join_small(chars: list[Piece]) -> None:
    """A reading that begins with small kana at a new surface character belongs with the character before."""
    for i in range(1, len(chars)):
        if chars[i].reading.startswith(_SMALL) and chars[i].inner == 0:
            for j in range(i - 1, len(chars)):
                if j > i and chars[j].inner == 0:
                    break
                chars[j].inner, chars[j].surface = j - i + 1, chars[i].surface


def characters(tokens: list[dict], dictionary: dict[str, list[str]] = KANJI) -> list[Piece]:
    """One piece for each reading character, with its surface character, token, phrase, subword and character number."""
    out, subword = [], -1
    for index, t in enumerate(tokens):
        surface, reading = t["surface_form"] or "", t["pronunciation"] or ""
        for part in allocate_kana(runs(surface), reading):
            kind = "sign" if t["pos"] == "記号" else part.kind
            if kind == "nonkana" and len(part.surface) > 1 and not _ASCII.fullmatch(part.surface):
                groups = []
                for s, r in allocate_kanji(part.surface, part.reading, dictionary):
                    chars = balanced(s, r)
                    if len(s) != 1:
                        _join_small(chars)
                    groups.append(chars)
            elif _KANA.fullmatch(part.surface) and len(part.surface) != len(part.reading):
                groups = [[Piece(part.surface[i : i + 1], c) for i, c in enumerate(part.reading)]]
            else:
                groups = [balanced(part.surface, part.reading)]
            for chars in groups:
                subword += 1
                out += [replace(c, kind=kind, token=index, phrase=t.get("phrase"), subword=subword) for c in chars]
    number, kept = -1, []
    for c in out:
        number += c.inner == 0
        c.char = number
        if c.kind != "sign":
            kept.append(c)
        elif kept:
            kept[-1].surface += c.surface
    return kept


def line_units(tokens: list[dict], dictionary: dict[str, list[str]] = KANJI) -> list[dict]:
    """The syllable units of a line. A character that is no kana makes a unit of its own."""
    chars = characters(tokens, dictionary)
    moras, mora, i = [], -1, 0
    while i < len(chars):
        j = i
        while j < len(chars) and chars[j].subword == chars[i].subword:
            j += 1
        text = "".join(c.reading for c in chars[i:j])
        owner, at = [-1] * len(text), 0
        for m in _SYLLABLE.finditer(text):
            for k in range(at, m.start()):
                mora += 1
                owner[k] = mora
            mora += 1
            owner[m.start() : m.end()] = [mora] * (m.end() - m.start())
            at = m.end()
        for k in range(at, len(text)):
            mora += 1
            owner[k] = mora
        at = 0
        for c in chars[i:j]:
            moras.append(owner[at] if c.reading else mora)
            at += len(c.reading)
        i = j
    out: list[dict] = []
    before = None
    for c, m in zip(chars, moras):
        surface = "" if before is not None and before.char == c.char else c.surface
        if out and out[-1]["mora"] == m:
            out[-1]["surface_form"] += surface
            out[-1]["pronunciation"] += c.reading
        else:
            out.append({"surface_form": surface, "token_index": c.token, "phrase": c.phrase, "pronunciation": c.reading, "subword": c.subword, "char_index": c.char, "mora": m})
        before = c
    return out


def align_line(tokens: Column, dictionary: dict[str, list[str]] | Column = KANJI) -> Column:
    """line_units of a column of token lists; dictionary may be a map column of each row's entries."""
    if isinstance(dictionary, Column):

        @F.pandas_udf(UNITS)
        def with_own(lists: pd.Series, known: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else line_units(list(x), {k: list(v) for k, v in dict(m or {}).items()}) for x, m in zip(lists, known)], dtype=object)

        return with_own(tokens, dictionary)

    @F.pandas_udf(UNITS)
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else line_units(list(x), dictionary) for x in lists])

    return run(tokens)


PIECES = "array<struct<surface:string,reading:string,token:int,phrase:int,subword:int,char_index:int,inner:int>>"


def line_pieces(tokens: Column, dictionary: dict[str, list[str]] = KANJI) -> Column:
    """The characters of a line's reading in order, with token, subword and number of the surface character, all counted from 0; signs have gone to the character before."""

    @F.pandas_udf(PIECES)
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _pieces(list(x), dictionary) for x in lists])

    return run(tokens)


def _pieces(tokens: list[dict], dictionary: dict[str, list[str]]) -> list[dict]:
    return [{"surface": c.surface, "reading": c.reading, "token": c.token, "phrase": c.phrase, "subword": c.subword, "char_index": c.char, "inner": c.inner} for c in characters(tokens, dictionary)]


def with_pieces(lines: DataFrame, dictionary: dict[str, list[str]] = KANJI, out: str = "pieces", tokens_col: str = "tokens") -> DataFrame:
    """lines with line_pieces of their tokens, some lines at a time."""
    return mapped(lines, out, PIECES, lambda values: [None if x is None else _pieces(x, dictionary) for x in values], F.col(tokens_col))


def kanji_pairs(surface: Column, reading: Column, dictionary: dict[str, list[str]] = KANJI) -> Column:
    @F.pandas_udf("array<struct<surface:string,reading:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"surface": s, "reading": r} for s, r in allocate_kanji(x or "", y or "", dictionary)] for x, y in zip(a, b)])

    return run(surface, reading)


def kana_pairs(surface: Column, reading: Column) -> Column:
    @F.pandas_udf("array<struct<surface:string,reading:string,type:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"surface": p.surface, "reading": p.reading, "type": p.kind} for p in allocate_kana(runs(x or ""), y or "")] for x, y in zip(a, b)])

    return run(surface, reading)
