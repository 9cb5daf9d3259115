"""Latin text to kana: apostrophes, romaji, dictionary words and spelling."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ENGLISH, LETTER_NAMES, romaji, romaji_pattern

#: Stands for an apostrophe while a tokenizer runs.
APOSTROPHE = "APOSTROPHE"
WIDE_LETTERS = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))


def apostrophe_to_string(s: Column) -> Column:
    return F.replace(F.translate(s, "’", "'"), F.lit("'"), F.lit(APOSTROPHE))


def apostrophe_to_sign(s: Column) -> Column:
    return F.replace(s, F.lit(APOSTROPHE), F.lit("'"))


def is_english_word(s: Column) -> Column:
    return s.rlike("^[a-zA-Z']+$")


def first_wide_letter(s: Column) -> Column:
    """The first full-width letter made half width; later ones stay."""
    head, tail = F.regexp_extract(s, "(?s)^(.*?[Ａ-Ｚａ-ｚ])(.*)$", 1), F.regexp_extract(s, "(?s)^(.*?[Ａ-Ｚａ-ｚ])(.*)$", 2)
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in WIDE_LETTERS)
    # head holds no other wide letter than its last character
    return F.when(~s.rlike(f"[{WIDE_LETTERS}]"), s).otherwise(F.concat(F.translate(head, WIDE_LETTERS, narrow), tail))


def literal_map(values: dict[str, str] | Column) -> Column:
    """values in the plan; a map column, such as dictionary.with_entries makes, stays itself."""
    if isinstance(values, Column):
        return values
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def is_romaji(s: Column) -> Column:
    return s.rlike(f"^{romaji_pattern()}+$")


def romaji_words_to_kana(s: Column) -> Column:
    """Kana of a lower-case word that romaji keys cover whole; keys are prefix-free, so that pieces are unique."""
    table = literal_map(romaji())
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(romaji_pattern()), 0), lambda k: F.element_at(table, k)), "")


def english_lookup(s: Column, dictionary: dict[str, str] | Column = ENGLISH) -> Column:
    return F.coalesce(F.try_element_at(literal_map(dictionary), F.upper(s)), s)


def spell_letters(s: Column, names: dict[str, str] = LETTER_NAMES) -> Column:
    """Upper case, with every letter A to Z as its name."""
    out = F.upper(s)
    for letter, name in names.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    return out


@cache
def _prefixes() -> frozenset[str]:
    return frozenset(k[:i] for k in romaji() for i in range(1, len(k)))


def roman_to_kana(text: str) -> str:
    """Romaji anywhere in a text as kana.

    Letters gather until they make a key. A letter that no key goes on with makes the pending
    ones ン after n, or ッ when it doubles the letter before it, and is looked at afresh;
    otherwise pending letters come out as they are. A pending n at the end is ン.
    """
    keys, starts = romaji(), _prefixes()
    low, out, key, pending = text.lower(), [], "", ""
    if len(low) != len(text):  # a few capitals have longer lower forms: offsets would not agree
        text = low
    i = 0
    while i < len(low):
        c = low[i]
        if "a" <= c <= "z":
            if key + c in keys:
                out.append(keys[key + c])
                key = pending = ""
                i += 1
                continue
            if key + c in starts:
                key += c
                pending += text[i]
                i += 1
                continue
            before = low[i - 1] if i else ""
            if before and before in ("n", c):
                out.append("ン" if before == "n" else "ッ")
                pending = ""
            if key:
                out.append(pending)
                key = pending = ""
                continue
        out.append(pending + text[i])
        key = pending = ""
        i += 1
    return "".join(out) + (pending[:-1] + "ン" if pending.endswith("n") else pending)


_WIDE = re.compile(f"[{WIDE_LETTERS}]")


def to_kana(text: str, dictionary: dict[str, str] = ENGLISH, names: dict[str, str] = LETTER_NAMES) -> str:
    """A dictionary word's kana, or romaji as kana and the letters left spelled."""
    text = _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text, count=1)
    text = roman_to_kana(dictionary.get(text.upper(), text)).upper()
    return "".join(names.get(c, c) for c in text)


@cache
def _machine() -> tuple[list[int], list[str]]:
    """The romaji keys as a transition table of 26 letters a state, and the kana: above 0 the next state, below 0 the kana that a letter completes, 0 neither."""
    keys = romaji()
    state = {p: i for i, p in enumerate(sorted(_prefixes(), key=lambda x: (len(x), x)), 1)} | {"": 0}
    kana = sorted(set(keys.values()))
    place = {k: i for i, k in enumerate(kana)}
    table = [0] * (26 * len(state))
    for p, i in state.items():
        for c in range(26):
            key = p + chr(97 + c)
            table[26 * i + c] = -1 - place[keys[key]] if key in keys else state.get(key, 0)
    return table, kana


def roman_letters_to_kana(s: Column) -> Column:
    """roman_to_kana as one fold over the characters.

    Every letter alone is a key or begins one, so a letter that does not go on with the pending
    ones always begins anew.
    """
    table, kana = _machine()
    steps, names = F.array(*map(F.lit, table)), F.array(*map(F.lit, kana))
    text = F.when(F.length(F.lower(s)) != F.length(s), F.lower(s)).otherwise(s)
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("pending"), F.lit(0).alias("state"), F.lit("").alias("before"))

    def begun(out: Column, pending: Column, letter: Column, c: Column, low: Column, state: Column | int):
        """The state after a letter: completed, or one more pending; null where it does neither."""
        t = F.get(steps, state * 26 + letter)
        new = lambda o, p, n: F.struct(o.alias("out"), p.alias("pending"), n.alias("state"), low.alias("before"))
        return F.when(t < 0, new(F.concat(out, F.get(names, -t - 1)), F.lit(""), F.lit(0))).when(t > 0, new(out, F.concat(pending, c), t))

    def step(acc, c):
        low = F.lower(c)
        letter = F.ascii(low) - 97
        mark = F.when(acc["before"] == "n", F.lit("ン")).when(acc["before"] == low, F.lit("ッ")).otherwise(acc["pending"])
        again = begun(F.concat(acc["out"], mark), F.lit(""), letter, c, low, 0)
        other = F.struct(F.concat(acc["out"], acc["pending"], c).alias("out"), F.lit("").alias("pending"), F.lit(0).alias("state"), low.alias("before"))
        return F.when((F.length(low) == 1) & letter.between(0, 25), F.coalesce(begun(acc["out"], acc["pending"], letter, c, low, acc["state"]), again)).otherwise(other)

    def end(acc):
        p = acc["pending"]
        return F.concat(acc["out"], F.when(p.endswith("n"), F.concat(F.left(p, F.length(p) - 1), F.lit("ン"))).otherwise(p))

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), 0), start, step, end)


def english_to_kana(s: Column, dictionary: dict[str, str] | Column = ENGLISH, names: dict[str, str] = LETTER_NAMES) -> Column:
    """to_kana of each value, native; each step's value is made once."""
    from .kana import let

    said = let(first_wide_letter(s), lambda x: english_lookup(x, dictionary))
    return spell_letters(let(said, roman_letters_to_kana), names)


def format_kana(s: Column, dictionary: dict[str, str] | Column = ENGLISH) -> Column:
    """A reading made uniform: Latin runs as kana, katakana, no signs, no unnatural kana."""
    from .kana import hira_to_kata, normalize_kana, remove_sign

    runs = F.transform(F.regexp_extract_all(s, F.lit("(?s)[a-zA-Z']+|[^a-zA-Z']+"), 0), lambda r: F.when(is_english_word(r), english_to_kana(r, dictionary)).otherwise(r))
    latin = F.when(s.rlike("[a-zA-Z']"), F.array_join(runs, "")).otherwise(s)
    return normalize_kana(remove_sign(hira_to_kata(latin)))
