"""Kana text functions as Column expressions: normalisation, classes, segmentation into units, variants.

Everything here stays inside Catalyst: translate and regexp functions, and higher-order
functions over the pieces of a string where replacements consume from left to right.
Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kana by vowel row, as the segmentation groups them.
ROW_A, ROW_I, ROW_U, ROW_E, ROW_O = "アカサタナハマヤラワガザダバパ", "イキシチニヒミリギジヂビピ", "ウクスツヌフムユルグズヅブプヴ", "エケセテネヘメレゲゼデベペ", "オコソトノホモヨロヲゴゾドボポ"
# Kana by vowel and by consonant, as the comparisons group them. ヲ has no vowel row, ヨ's small form no row, and bare vowels no consonant.
VOWEL_ROWS = {"ア": ROW_A + "ァャヮ", "イ": ROW_I + "ィ", "ウ": ROW_U + "ゥュ", "エ": ROW_E + "ェ", "オ": ROW_O.replace("ヲ", "") + "ォ"}
CONSONANT_ROWS = {"k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "y": "ヤユヨ", "r": "ラリルレロ", "w": "ワ", "g": "ガギグゲゴ", "z": "ザジヂズゼゾ", "d": "ダヅデド", "b": "バビブヴベボ", "p": "パピプペポ"}
SMALL, LARGE = "ァィゥェォヮャュョ", "アイウエオワヤユヨ"
SMALL_HIRA, LARGE_HIRA = "ぁぃぅぇぉゎゃゅょ", "あいうえおわやゆよ"
HIRA = "".join(map(chr, range(0x3041, 0x3097)))
KATA = "".join(chr(ord(c) + 0x60) for c in HIRA)
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "”’‘￥\u3000〜"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + "\"'`\\ ~"
#: All white space, in a form that every regular expression engine reads alike.
SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII punctuation but the underscore, as a class body.
SIGNS = r"!-/:-@\[-\^`\{-~"

_I2 = ROW_I[1:]
# Two-kana units: every family of kana and small kana that makes one unit.
DIGRAPH = f"(?:[{ROW_U}][ァィェォ]|[テデ][ャィュョ]|[{ROW_I}][ャュョ]|[{_I2}]ェ|[トド]ゥ)"
BASE = "[アイウエオ-ヂツ-モヤユヨ-ロワヲヴ]"
MORA = f"[{ROW_U[:-1]}][ァヮィェォ]|[{_I2}テデ][ャュョ]|[{ROW_I}]ェ|[テデ]ィ|[トド]ゥ|[ァ-ヴー]"
_BACK = "(?:ーッ|ンッ|ーン(?![ーッ])|ー|ッ|ン(?!ー))"
#: Digraphs that lengthen with a following vowel kana, by that vowel.
_DIGRAPH_A = f"(?:[{ROW_U}][ァヮ]|[{_I2}]ャ|[テデ]ャ)ア"
_DIGRAPH_I = f"(?:[{ROW_U}]ィ|[テデ]ィ)イ(?!ェ)"
_DIGRAPH_U = f"(?:[{ROW_I}]ュ|[テデ]ュ|[トド]ゥ)ウ(?![ァィェォ])"
_DIGRAPH_E = f"(?:[{ROW_U}]ェ|[{ROW_I}]ェ)[エイ]"
_DIGRAPH_O = f"(?:[{ROW_U}]ォ|[{_I2}]ョ)(?:オ|ウ(?![ァィェォ]))"
_PAIR = f"[{ROW_A}]ア|[{ROW_I}]イ|[{ROW_U}]ウ(?![ァィェォ])|[{ROW_E}][エイ]|[{ROW_O}](?:オ|ウ(?![ァィェォ]))"
#: A syllable of two kana or more; in front of everything else, longest families first.
LONG_SYLLABLE = f"{DIGRAPH}{_BACK}|(?:{_DIGRAPH_A}|{_DIGRAPH_I}|{_DIGRAPH_U}|{_DIGRAPH_E}|{_DIGRAPH_O})(?![ーンッ])|{DIGRAPH}|ン(?:[ーッ]|ーッ)|{BASE}{_BACK}|(?:{_PAIR})(?![ーンッ])"
SYLLABLE = f"{LONG_SYLLABLE}|[ァ-ヴー]"
PHONON = f"{DIGRAPH}ー|(?:{_DIGRAPH_A}|{_DIGRAPH_I}|{_DIGRAPH_U}|{_DIGRAPH_E}|{_DIGRAPH_O})(?!ー)|{DIGRAPH}|ンー|{BASE}ー|(?:{_PAIR})(?!ー)|[ァ-ヴー]"
#: Small kana that stay small after the kana before them.
STICKY = f"[{ROW_U}][ァィェォ]|[テデ][ャィュョ]|[{ROW_I}][ャュョ]|[{_I2}]ェ|[トド]ゥ"
LEGAL_PAIR = f"[{ROW_U}][ァヮォ]|[トド]ゥ|[{_I2}テデ][ャュョ]|[{ROW_U}テデ]ィ|[{ROW_U}{_I2}イ]ェ"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hira_to_kata(s: Column) -> Column:
    return F.translate(s, HIRA, KATA)


def to_half_width(s: Column) -> Column:
    return F.translate(s, WIDE, NARROW)


def remove_sign(s: Column) -> Column:
    """Half width, without ASCII punctuation (but the underscore), white space and the Japanese signs."""
    return F.regexp_replace(to_half_width(s), f"[{SIGNS}{SPACE}・「」。、]", "")


def _vowel_of(c: Column) -> Column:
    """The vowel kana of one kana; sp of ン and ッ; others themselves."""
    src, dst = "".join(VOWEL_ROWS.values()), "".join(v * len(r) for v, r in VOWEL_ROWS.items())
    return F.when(c.isin("ン", "ッ"), F.lit("sp")).otherwise(F.translate(c, src, dst))


def kana_vowel(s: Column) -> Column:
    """The vowel of a unit's last kana besides long bars."""
    core = F.regexp_replace(s, "ー+$", "")
    return F.when(core == "", F.when(s == "", s).otherwise(F.lit("ー"))).otherwise(_vowel_of(F.right(core, F.lit(1))))


def kana_consonant(s: Column) -> Column:
    """The consonant code of a unit's first kana, empty for bare vowels, ヲ and ー."""
    first = F.left(s, F.lit(1))
    src, dst = "".join(CONSONANT_ROWS.values()), "".join(c * len(r) for c, r in CONSONANT_ROWS.items())
    return F.when(first.isin("ン", "ッ"), F.lit("sp")).when(F.instr(F.lit(src), first) > 0, F.translate(first, src, dst)).otherwise(F.lit(""))


def bar_to_vowel(s: Column) -> Column:
    """Every kana with a long bar as the kana and its vowel."""

    def piece(p):
        first = F.left(p, F.lit(1))
        return F.when(F.length(p) < 2, p).when(first.isin("ン", "ッ"), F.concat(first, first)).otherwise(F.concat(first, _vowel_of(first)))

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)[ァ-ンヴ]ー|."), 0), piece), "")


def small_vowel_to_bar(s: Column) -> Column:
    """Runs of a small vowel after a kana of that vowel, or longer runs, as a long bar."""
    runs = "(?:ァ+|ィ+|ゥ+|ェ+|ォ+)"

    def piece(p):
        first, second = F.left(p, F.lit(1)), F.substring(p, 2, 1)
        same = F.translate(_vowel_of(first), LARGE[:5], SMALL[:5]) == second
        return F.when(F.length(p) < 2, p).when(same & F.instr(F.lit(LARGE[:5]), _vowel_of(first)).cast("boolean"), F.concat(first, F.lit("ー"))).when(F.length(p) > 2, F.concat(first, second, F.lit("ー"))).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(F.regexp_replace(s, f"ー{runs}", "ー"), F.lit(f"(?s)[ァ-ヴ]{runs}|."), 0), piece), "")


def small_vowel_to_large(s: Column) -> Column:
    """Small kana that make no unit with the kana before them, enlarged."""

    def piece(p):
        first, second = F.left(p, F.lit(1)), F.substring(p, 2, 1)
        grown = F.when(F.instr(F.lit(SMALL), first) > 0, F.concat(F.translate(first, SMALL, LARGE), second)).otherwise(F.concat(first, F.translate(second, SMALL, LARGE)))
        return F.when((F.length(p) < 2) | p.rlike(LEGAL_PAIR), p).otherwise(grown)

    out = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"(?s)[^\n][{SMALL}]|."), 0), piece), "")
    for a, b in zip(SMALL, LARGE):
        out = F.regexp_replace(out, f"(^|\n){a}", f"$1{b}")
    return out


def dedup_bar_sokuon(s: Column) -> Column:
    """Without runs of bars, bars and ッ after ッ, and bars and ッ in front."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "ー+", "ー"), "ッ[ーッ]+", "ッ"), "^[ーッ]+", "")


def normalize_kana(s: Column) -> Column:
    return dedup_bar_sokuon(small_vowel_to_large(small_vowel_to_bar(s)))


def absorb_small_kana(s: Column) -> Column:
    """Small kana that do not stick to the already normalised kana before them, enlarged one for one."""

    def step(acc, c):
        pair = hira_to_kata(F.concat(F.right(acc, F.lit(1)), c))
        small = F.instr(F.lit(SMALL + SMALL_HIRA), c) > 0
        return F.concat(acc, F.when(small & ~((F.length(pair) == 2) & pair.rlike(STICKY)), F.translate(c, SMALL + SMALL_HIRA, LARGE + LARGE_HIRA)).otherwise(c))

    return F.aggregate(F.regexp_extract_all(s, F.lit("(?s)."), 0), F.lit(""), step)


def mora_split(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(MORA), 0)


def syllable_split(s: Column) -> Column:
    """Syllables in order; characters that are no kana drop out."""
    return F.regexp_extract_all(s, F.lit(SYLLABLE), 0)


def phonon_split(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(PHONON), 0)


def is_syllable(s: Column) -> Column:
    """Whether all of s is one syllable of two kana or more."""
    return s.rlike(f"^(?:{LONG_SYLLABLE})$")


VARIANT = "array<struct<units:array<string>,cost:int>>"


def syllable_variants(s: Column) -> Column:
    """The ways to say one syllable, each with its number of edits; the first kind that fits decides."""

    def ways(*rows):
        return F.array(*(F.struct((F.array(*units) if units else F.array().cast("array<string>")).alias("units"), F.lit(cost).alias("cost")) for units, cost in rows)).cast(VARIANT)

    n, t, bar = F.lit("ン"), F.lit("ッ"), F.lit("ー")
    one, two = F.left(s, F.length(s) - 1), F.left(s, F.length(s) - 2)
    long1, long2 = F.concat(one, bar), F.concat(two, bar)
    return (
        F.when(s.rlike("^[アイウエオ]$"), ways(([s], 0)))
        .when(s.isin("ン", "ッ"), ways(([s], 0), ([], 1)))
        .when(s == "ンー", ways(([n, n], 1), ([n], 1), ([], 2)))
        .when(s == "ンッ", ways(([n, t], 0), ([n], 1), ([t], 1), ([], 2)))
        .when(s.endswith("ーン"), ways(([long2, n], 0), ([long2], 1)))
        .when(s.endswith("ンッ"), ways(([two, n, t], 0), ([two, n], 1), ([long2, t], 1), ([long2], 2), ([two, t], 1)))
        .when(s.endswith("ーッ"), ways(([long2, t], 0), ([long2], 1)))
        .when(s.endswith("ー"), ways(([s], 0)))
        .when(s.endswith("ッ"), ways(([one, t], 0), ([one], 1), ([long1], 1)))
        .when(s.endswith("ン"), ways(([one, n], 0), ([long1], 1), ([one], 1)))
        .when(s.rlike("[アイウエオ]$"), ways(([one, F.right(s, F.lit(1))], 0), ([long1], 0)))
        .otherwise(ways(([s], 0)))
    )


VARIATION = "array<struct<units:array<string>,vcost:int,src:array<int>>>"


def variations(syllables: Column, max_units: Column | int | None = None) -> Column:
    """All ways to say a list of syllables, the last syllable's turning fastest.

    src: each unit's syllable. Ways without a unit are left out. With max_units, ways with more
    units are cut as soon as the units so far and the fewest that must follow are too many.
    """
    least = F.transform(syllables, lambda s: F.array_min(F.transform(syllable_variants(s), lambda v: F.size(v["units"]))))
    levels = F.transform(syllables, lambda s, i: F.struct(syllable_variants(s).alias("ways"), i.alias("i"), F.aggregate(F.slice(least, i + 2, F.size(syllables)), F.lit(0), lambda a, b: a + b).alias("rest")))
    start = F.array(F.struct(F.array().cast("array<string>").alias("units"), F.lit(0).alias("vcost"), F.array().cast("array<int>").alias("src"))).cast(VARIATION)

    def step(acc, level):
        grown = F.flatten(
            F.transform(acc, lambda a: F.transform(level["ways"], lambda v: F.struct(F.concat(a["units"], v["units"]).alias("units"), (a["vcost"] + v["cost"]).alias("vcost"), F.concat(a["src"], F.array_repeat(level["i"], F.size(v["units"]))).alias("src"))))
        )
        return grown if max_units is None else F.filter(grown, lambda g: F.size(g["units"]) + level["rest"] <= max_units)

    return F.filter(F.aggregate(levels, start, step), lambda v: F.size(v["units"]) > 0)


def ways(text: Column, max_units: Column | int | None = None) -> Column:
    """variations of a kana text, split once."""
    return let(syllable_split(text), lambda s: variations(s, max_units))


def vowel_to_bar(s: Column) -> Column:
    """Null: a function of the interface that never had a result."""
    return F.when(s.isNull() | s.isNotNull(), F.lit(None).cast("string"))


to_katakana = format_text = vowel_to_bar


class KanaConverter:
    """Splitting, ways to say and likenesses of units, under one name."""

    separate = staticmethod(syllable_split)
    get_pronunciation_variation = staticmethod(variations)

    @staticmethod
    def is_same_kana(a: Column, b: Column) -> Column:
        return a == b

    @staticmethod
    def is_same_vowel(a: Column, b: Column) -> Column:
        return kana_vowel(a) == kana_vowel(b)

    @staticmethod
    def is_same_consonant(a: Column, b: Column) -> Column:
        return kana_consonant(a) == kana_consonant(b)

    @staticmethod
    def is_same_bar(a: Column, b: Column) -> Column:
        return a.endswith("ー") & b.endswith("ー")

    @staticmethod
    def is_same_hatsuon(a: Column, b: Column) -> Column:
        return a.endswith("ン") & b.endswith("ン")

    @staticmethod
    def is_same_sokuon(a: Column, b: Column) -> Column:
        return a.endswith("ッ") & b.endswith("ッ")
