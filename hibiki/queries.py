"""The registered queries of the library, each with its SQL where SQL can express it.

The tables hold no kana, so kana words come from the documents: every distinct lower-case word,
however long, that romaji keys cover whole. Endings by length bring in long bars, ン, ッ
and small kana.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import english, kana, ruby
from .functions import lexicon as lex
from .operators import align, distance, lattice, segment, tokens
from .plans import where as wh
from .sources import dictionary, wordlist

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _SQL[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- kana words ---------------------------------------------------------------------------------

KEY = lex.romaji_pattern()
ENDINGS = ["", "ー", "ン", "ッ", "ァ", "ンッ", "ーン", "ュ", "ィィ", "ゥー"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in values.items()) + "}"


def latin_places(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w"))


def latin_words(docs: DataFrame) -> DataFrame:
    return latin_places(docs).distinct()


def romaji_words(docs: DataFrame) -> DataFrame:
    """(w, kana, s): words, their kana, and the kana with an ending; words are made distinct before they are read."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the test names the count, so that it is not moved in front of the grouping, where it would read every place of a word
    told = latin_places(docs).groupBy("w").agg(F.count("*").alias("n")).repartition(n, "w").where(F.when(F.col("n") > 0, english.is_romaji(F.col("w"))))
    out = told.select("w", english.romaji_words_to_kana(F.col("w")).alias("kana"))
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.ascii("w") * 7 + F.length("w")) % 10 + 1)
    return out.withColumn("s", F.concat("kana", ending, F.left("kana", F.lit(1))))


def words_sql(source: str = "documents", name: str = "deco") -> str:
    return f"""{name}_w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {source}) WHERE regexp_full_match(w, '{KEY}+')),
{name}_k AS (SELECT w, array_to_string(list_transform(regexp_extract_all(w, '{KEY}'), lambda k: ({sql_map(lex.romaji())})[k]), '') AS kana FROM {name}_w),
{name} AS (SELECT w, kana, kana || ([{', '.join(map(q, ENDINGS))}])[(ascii(w) * 7 + length(w)) % 10 + 1] || left(kana, 1) AS s FROM {name}_k)"""


def on_words(name: str, out: Callable[[Column], Column], sql: str | None, given: Callable[[Column], Column] | None = None) -> None:
    """A query of one function over all kana words; in sql, s is the word."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = romaji_words(table(spark, sf_dir, "documents"))
        x = given(F.col("s")) if given else F.col("s")
        return base.select("w", x.alias("x")).select("w", out(F.col("x")).alias("out"))

    register(name, run, sql and f"WITH {words_sql()} SELECT w, {sql} AS out FROM deco")


def joined(a: Column) -> Column:
    return F.array_join(a, "|")


def d_vowel(c: str) -> str:
    src, dst = "".join(kana.VOWEL_ROWS.values()), "".join(v * len(r) for v, r in kana.VOWEL_ROWS.items())
    return f"(CASE WHEN {c} IN ('ン', 'ッ') THEN 'sp' ELSE translate({c}, '{src}', '{dst}') END)"


def d_last_vowel(s: str) -> str:
    core = f"regexp_replace({s}, 'ー+$', '')"
    return f"(CASE WHEN {core} = '' THEN (CASE WHEN {s} = '' THEN '' ELSE 'ー' END) ELSE {d_vowel(f'right({core}, 1)')} END)"


def d_consonant(s: str) -> str:
    src, dst = "".join(kana.CONSONANT_ROWS.values()), "".join(c * len(r) for c, r in kana.CONSONANT_ROWS.items())
    return f"(CASE WHEN left({s}, 1) IN ('ン', 'ッ') THEN 'sp' WHEN strpos('{src}', left({s}, 1)) > 0 AND {s} <> '' THEN translate(left({s}, 1), '{src}', '{dst}') ELSE '' END)"


def d_pieces(s: str, pattern: str, body: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({s}, '{pattern}'), lambda p: {body}), '')"


RUNS = "(?:ァ+|ィ+|ゥ+|ェ+|ォ+)"
S5, L5 = kana.SMALL[:5], kana.LARGE[:5]


def d_to_bar(s: str) -> str:
    v = d_vowel("left(p, 1)")
    body = f"CASE WHEN length(p) < 2 THEN p WHEN {v} IN ('ア', 'イ', 'ウ', 'エ', 'オ') AND translate({v}, '{L5}', '{S5}') = p[2] THEN left(p, 1) || 'ー' WHEN length(p) > 2 THEN left(p, 2) || 'ー' ELSE p END"
    return d_pieces(f"regexp_replace({s}, 'ー{RUNS}', 'ー', 'g')", f"[ァ-ヴ]{RUNS}|.", body)


def d_to_large(s: str) -> str:
    body = f"CASE WHEN length(p) < 2 OR regexp_matches(p, '{kana.LEGAL_PAIR}') THEN p WHEN strpos('{kana.SMALL}', left(p, 1)) > 0 THEN translate(left(p, 1), '{kana.SMALL}', '{kana.LARGE}') || p[2] ELSE left(p, 1) || translate(p[2], '{kana.SMALL}', '{kana.LARGE}') END"
    inner = d_pieces(s, f".[{kana.SMALL}]|.", body)
    return f"translate(left({inner}, 1), '{kana.SMALL}', '{kana.LARGE}') || substr({inner}, 2)"


def d_dedup(s: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({s}, 'ー+', 'ー', 'g'), 'ッ[ーッ]+', 'ッ', 'g'), '^[ーッ]+', '')"


def d_absorb(s: str) -> str:
    return f"list_reduce(list_prepend('', string_split({s}, '')), lambda acc, c: acc || (CASE WHEN strpos('{kana.SMALL}', c) > 0 AND c <> '' AND NOT (acc <> '' AND regexp_matches(right(acc, 1) || c, '^(?:{kana.STICKY})$')) THEN translate(c, '{kana.SMALL}', '{kana.LARGE}') ELSE c END))"


on_words("hira_to_kata", kana.hira_to_kata, f"translate(translate(s, '{kana.KATA}', '{kana.HIRA}'), '{kana.HIRA}', '{kana.KATA}')", lambda s: F.translate(s, kana.KATA, kana.HIRA))
on_words("kana_vowel", kana.kana_vowel, d_last_vowel("s"))
on_words("kana_consonant", kana.kana_consonant, d_consonant("s"))
on_words("bar_to_vowel", kana.bar_to_vowel, d_pieces("s", "[ァ-ンヴ]ー|.", f"CASE WHEN length(p) < 2 THEN p WHEN left(p, 1) IN ('ン', 'ッ') THEN left(p, 1) || left(p, 1) ELSE left(p, 1) || {d_vowel('left(p, 1)')} END"))
on_words("small_vowel_to_bar", kana.small_vowel_to_bar, d_to_bar("s"))
on_words("small_vowel_to_large", kana.small_vowel_to_large, d_to_large("s"))
on_words("dedup_bar_sokuon", kana.dedup_bar_sokuon, d_dedup("s || 'ーーッー'"), lambda s: F.concat(s, F.lit("ーーッー")))
on_words("absorb_small_kana", kana.absorb_small_kana, d_absorb("s"))
on_words("mora_split", lambda s: joined(kana.mora_split(s)), f"array_to_string(regexp_extract_all(s, '{kana.MORA}'), '|')")
register(
    "normalize_kana",
    lambda spark, d: romaji_words(table(spark, d, "documents")).select("w", kana.normalize_kana(F.col("s")).alias("out")),
    f"WITH {words_sql()}, a AS (SELECT w, {d_to_bar('s')} AS b FROM deco), c AS (SELECT w, {d_to_large('b')} AS t FROM a) SELECT w, {d_dedup('t')} AS out FROM c",
)


# -- syllables: RE2 has no lookahead, so the SQL marks the kana that a lookahead would spare -------

# private-use marks: a vowel before a bar, ン or ッ; ウ before a small vowel; イ before ェ; ンー; ンッ after a bar
_M = dict(zip("アイウエオ", map(chr, range(0xE001, 0xE006))))
_MU, _MI, _MNB, _MNT = map(chr, range(0xE006, 0xE00A))


def d_syllables(s: str) -> tuple[str, str]:
    """SQL for the marked string, and the pattern over it."""
    out = s
    for v, m in _M.items():
        out = f"regexp_replace({out}, '{v}([ーンッ])', '{m}\\1', 'g')"
    out = f"regexp_replace({out}, 'ウ([ァィェォ])', '{_MU}\\1', 'g')"
    out = f"replace({out}, 'イェ', '{_MI}ェ')"
    out = f"replace({out}, 'ーンッ', 'ー{_MNT}')"
    out = f"replace({out}, 'ンー', '{_MNB}')"
    marks = "".join(_M.values()) + _MU + _MI
    u, i, i2 = kana.ROW_U + _MU, kana.ROW_I + _MI, kana.ROW_I[1:]
    di = f"(?:[{u}][ァィェォ]|[テデ][ャィュョ]|[{i}][ャュョ]|[{i2}]ェ|[トド]ゥ)"
    base = f"[アイウエオ-ヂツ-モヤユヨ-ロワヲヴ{marks}]"
    back = "(?:ーッ|ンッ|ーン|ー|ッ|ン)"
    long_di = f"(?:(?:[{u}][ァヮ]|[{i2}]ャ|[テデ]ャ)ア|(?:[{u}]ィ|[テデ]ィ)イ|(?:[{i}]ュ|[テデ]ュ|[トド]ゥ)ウ|(?:[{u}]ェ|[{i}]ェ)[エイ{_MI}]|(?:[{u}]ォ|[{i2}]ョ)(?:オ|ウ))"
    pair = f"(?:[{kana.ROW_A}]ア|[{i}][イ{_MI}]|[{u}]ウ|[{kana.ROW_E}][エイ{_MI}]|[{kana.ROW_O}](?:オ|ウ))"
    return out, f"{di}{back}|{long_di}|{di}|ン[ーッ]|{_MNB}ッ|{_MNB}|{_MNT}|{base}{back}|{pair}|[ァ-ヴー{marks}]"


def d_unmark(s: str) -> str:
    return f"replace(replace(translate({s}, '{''.join(_M.values())}{_MU}{_MI}', 'アイウエオウイ'), '{_MNB}', 'ンー'), '{_MNT}', 'ンッ')"


_MARKED, _SYLLABLES = d_syllables("s")
D_SPLIT = f"list_transform(regexp_extract_all({_MARKED}, '{_SYLLABLES}'), lambda p: {d_unmark('p')})"
on_words("syllable_split", lambda s: joined(kana.syllable_split(s)), f"array_to_string({D_SPLIT}, '|')")


def is_syllable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of one to four kana in the words, and whether it is one syllable."""
    s = F.col("s")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length(s) - i + 1)), lambda n: F.substring(s, i, n))))
    return romaji_words(table(spark, sf_dir, "documents")).select(F.explode(runs).alias("s")).distinct().select("s", kana.is_syllable(s).alias("out"))


register(
    "is_syllable",
    is_syllable,
    f"WITH {words_sql()}, pl AS (SELECT s AS whole, unnest(range(1, length(s) + 1)) AS i FROM deco), run AS (SELECT DISTINCT substr(whole, i, n) AS s FROM (SELECT whole, i, unnest([1, 2, 3, 4]) AS n FROM pl) WHERE i + n - 1 <= length(whole)), cut AS (SELECT s, {D_SPLIT} AS x FROM run) SELECT s, (len(x) = 1 AND length(x[1]) > 1 AND x[1] = s) AS out FROM cut",
)
on_words("phonon_split", lambda s: joined(kana.phonon_split(s)), None)


def variant_text(v: Column) -> Column:
    return joined(F.transform(v, lambda x: F.concat(F.array_join(x["units"], "."), F.lit(":"), x["cost"].cast("string"))))


D_VARIANTS = """CASE WHEN regexp_full_match(y, '[アイウエオ]') THEN y || ':0' WHEN y IN ('ン', 'ッ') THEN y || ':0|:1'
WHEN y = 'ンー' THEN 'ン.ン:1|ン:1|:2' WHEN y = 'ンッ' THEN 'ン.ッ:0|ン:1|ッ:1|:2'
WHEN y LIKE '%ーン' THEN y[:-3] || 'ー.ン:0|' || y[:-3] || 'ー:1'
WHEN y LIKE '%ンッ' THEN y[:-3] || '.ン.ッ:0|' || y[:-3] || '.ン:1|' || y[:-3] || 'ー.ッ:1|' || y[:-3] || 'ー:2|' || y[:-3] || '.ッ:1'
WHEN y LIKE '%ーッ' THEN y[:-3] || 'ー.ッ:0|' || y[:-3] || 'ー:1' WHEN y LIKE '%ー' THEN y || ':0'
WHEN y LIKE '%ッ' THEN y[:-2] || '.ッ:0|' || y[:-2] || ':1|' || y[:-2] || 'ー:1'
WHEN y LIKE '%ン' THEN y[:-2] || '.ン:0|' || y[:-2] || 'ー:1|' || y[:-2] || ':1'
WHEN regexp_matches(y, '[アイウエオ]$') THEN y[:-2] || '.' || y[-1] || ':0|' || y[:-2] || 'ー:0' ELSE y || ':0' END"""

register(
    "syllable_variants",
    lambda spark, d: romaji_words(table(spark, d, "documents")).select(F.explode(kana.syllable_split(F.col("s"))).alias("y")).distinct().select("y", variant_text(kana.syllable_variants(F.col("y"))).alias("out")),
    f"WITH {words_sql()}, t AS (SELECT DISTINCT unnest({D_SPLIT}) AS y FROM deco) SELECT y, {D_VARIANTS} AS out FROM t",
)

WAYS_SQL = f"""syl AS (SELECT w, {D_SPLIT} AS sy FROM deco),
lv AS (SELECT w, len(sy) AS n, unnest(range(len(sy))) AS i, unnest(sy) AS y FROM syl),
va AS (SELECT w, n, i, string_split({D_VARIANTS}, '|') AS vs FROM lv),
vv AS (SELECT w, n, i, unnest(vs) AS v, unnest(range(len(vs))) AS k FROM va),
ve AS (SELECT w, n, i, k, list_filter(string_split(split_part(v, ':', 1), '.'), lambda u: u <> '') AS us, split_part(v, ':', 2)::INTEGER AS c FROM vv)"""
WAYS_RECURSIVE = """ways(w, n, i, ord, units, cost, src) AS (
  SELECT w, n, i, [k], us, c, list_transform(us, lambda u: 0::BIGINT) FROM ve WHERE i = 0
  UNION ALL
  SELECT a.w, a.n, b.i, list_append(a.ord, b.k), list_concat(a.units, b.us), a.cost + b.c, list_concat(a.src, list_transform(b.us, lambda u: b.i)) FROM ways a JOIN ve b ON a.w = b.w AND b.i = a.i + 1)"""


def word_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = romaji_words(table(spark, sf_dir, "documents"))
    return base.select("w", "s", F.posexplode(kana.ways(F.col("s"))).alias("ordinal", "v")).select("w", "s", "ordinal", F.col("v.units").alias("units"), F.col("v.vcost").alias("vcost"), F.col("v.src").alias("src"))


register(
    "variations",
    lambda spark, d: word_ways(spark, d).select("w", F.col("ordinal").cast("long").alias("ordinal"), joined(F.col("units")).alias("units"), F.col("vcost").cast("int").alias("vcost"), joined(F.col("src").cast("array<string>")).alias("src")),
    f"WITH RECURSIVE {words_sql()}, {WAYS_SQL}, {WAYS_RECURSIVE} SELECT w, row_number() OVER (PARTITION BY w ORDER BY ord) - 1 AS ordinal, array_to_string(units, '|') AS units, cost AS vcost, array_to_string(src, '|') AS src FROM ways WHERE i = n - 1 AND len(units) > 0",
)
register(
    "bucket_sizes",
    lambda spark, d: word_ways(spark, d).groupBy(F.size("units").cast("long").alias("n_units")).agg(F.count("*").alias("n")),
    f"WITH RECURSIVE {words_sql()}, {WAYS_SQL}, {WAYS_RECURSIVE} SELECT len(units)::BIGINT AS n_units, count(*) AS n FROM ways WHERE i = n - 1 AND len(units) > 0 GROUP BY 1",
)

# -- Latin ---------------------------------------------------------------------------------------

register("romaji_to_kana", lambda spark, d: romaji_words(table(spark, d, "documents")).select("w", "kana"), f"WITH {words_sql()} SELECT w, kana FROM deco")
register(
    "to_half_width",
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.translate("p_name", kana.NARROW[:94], kana.WIDE[:94]).alias("x")).select("p_partkey", kana.to_half_width(F.concat("x", F.lit("”’‘￥　〜"))).alias("out")),
    f"SELECT p_partkey, translate(translate(p_name, {q(kana.NARROW[:94])}, {q(kana.WIDE[:94])}) || '”’‘￥　〜', {q(kana.WIDE)}, {q(kana.NARROW)}) AS out FROM part",
)
register("remove_sign", lambda spark, d: table(spark, d, "documents").select("doc_id", kana.remove_sign(F.col("text")).alias("out")), f"SELECT doc_id, regexp_replace(translate(text, {q(kana.WIDE)}, {q(kana.NARROW)}), '[{kana.SIGNS}{kana.SPACE}・「」。、]', '', 'g') AS out FROM documents")
register("apostrophe", lambda spark, d: table(spark, d, "documents").select("doc_id", english.apostrophe_to_sign(english.apostrophe_to_string(F.replace("text", F.lit(","), F.lit("’")))).alias("out")), "SELECT doc_id, replace(replace(replace(replace(text, ',', '’'), '’', ''''), '''', 'APOSTROPHE'), 'APOSTROPHE', '''') AS out FROM documents")
register("is_english_word", lambda spark, d: latin_words(table(spark, d, "documents")).select("w", english.is_english_word(F.col("w")).alias("out")), "SELECT DISTINCT w, regexp_full_match(w, '[a-zA-Z'']+') AS out FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
register(
    "zenkaku_first",
    lambda spark, d: table(spark, d, "part").select("p_partkey", english.first_wide_letter(F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", english.WIDE_LETTERS[26:])).alias("out")),
    f"WITH t AS (SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '{english.WIDE_LETTERS[26:]}') AS x FROM part), u AS (SELECT *, regexp_extract(x, '[Ａ-Ｚａ-ｚ]') AS c FROM t) SELECT p_partkey, CASE WHEN c = '' THEN x ELSE left(x, strpos(x, c) - 1) || translate(c, '{english.WIDE_LETTERS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') || substr(x, strpos(x, c) + 1) END AS out FROM u",
)


def d_spell(s: str) -> str:
    out = f"upper({s})"
    for letter, name in lex.LETTER_NAMES.items():
        out = f"replace({out}, '{letter}', '{name}')"
    return out


register("spell_letters", lambda spark, d: table(spark, d, "part").select("p_partkey", english.spell_letters(F.col("p_name")).alias("out")), f"SELECT p_partkey, {d_spell('p_name')} AS out FROM part")
register(
    "english_lookup",
    lambda spark, d: dictionary.looked_up(table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")), "word", dictionary.english(spark), "out").select("p_partkey", F.col("i").cast("long").alias("i"), "out"),
    f"WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part), u AS (SELECT p_partkey, unnest(range(len(a))) AS i, unnest(a) AS word FROM t) SELECT p_partkey, i, coalesce(({sql_map(lex.ENGLISH)})[upper(word)], word) AS out FROM u",
)
register("format_kana", lambda spark, d: table(spark, d, "part").select("p_partkey", english.format_kana(F.col("p_name")).alias("out")))
KANJI_TEXT = "translate(p_name, 'abcdefghijkl', '山川東京日本花火大小人空')"
register(
    "kanji_to_kana",
    lambda spark, d: dictionary.kanji_texts(table(spark, d, "part").select("p_partkey", F.expr(KANJI_TEXT).alias("text")), "p_partkey", "text", dictionary.kanji(spark), "out"),
    f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split({KANJI_TEXT}, ''), lambda c: ({sql_map({k: v[0] for k, v in lex.KANJI.items()})})[c]), lambda x: x IS NOT NULL), '') AS out FROM part",
)

# -- word lists and filters ------------------------------------------------------------------------

TIDY = "p_partkey || ' , ' || p_name || ',' || p_type || ', ' || p_brand"


def tidy_part(spark: SparkSession, sf_dir: str, query: str = "") -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.expr(TIDY).alias("value"))
    return wordlist.tidy(lines, "id,original , surface,brand", query)


register("scan_tidy", lambda spark, d: tidy_part(spark, d), "SELECT p_partkey::VARCHAR AS id, p_name AS original, p_type AS surface, p_brand AS brand FROM part")
register(
    "scan_plain",
    lambda spark, d: wordlist.plain(table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_size % 7 = 0 THEN '# ' || p_brand WHEN p_size % 3 = 0 THEN p_name || ' # ' || p_brand ELSE p_name || ',' || p_type || ',,' || p_brand || '#x' END").alias("value")), "p_partkey").select("id", F.col("seq").cast("long").alias("seq"), "original", "surface", "pronunciation"),
    """WITH l AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '# ' || p_brand WHEN p_size % 3 = 0 THEN p_name || ' # ' || p_brand ELSE p_name || ',' || p_type || ',,' || p_brand || '#x' END AS v FROM part),
c AS (SELECT p_partkey, string_split(regexp_replace(v, '#.*$', ''), ',') AS a FROM l),
n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, a FROM c WHERE a[1] <> ''),
r AS (SELECT id, a[1] AS original, CASE WHEN len(a) = 1 THEN a ELSE list_filter(a[2:], lambda x: x <> '') END AS b FROM n)
SELECT id::VARCHAR AS id, unnest(range(len(b))) AS seq, trim(original) AS original, trim(original) AS surface, ltrim(unnest(b)) AS pronunciation FROM r""",
)
for _name, _query, _sql in (
    ("where_eq", "brand = Brand#11 or surface = PROMO", "p_brand = 'Brand#11' OR p_type = 'PROMO'"),
    ("where_ne", "brand != Brand#11", "p_brand <> 'Brand#11'"),
    ("where_contains", "original ~= ring and brand ~= 2", "contains(p_name, 'ring') AND contains(p_brand, '2')"),
    ("where_not_contains", "original !~= e", "NOT contains(p_name, 'e')"),
    ("where_left_assoc", "brand ~= 1 or brand ~= 2 and original ~= ring", "(contains(p_brand, '1') OR contains(p_brand, '2')) AND contains(p_name, 'ring')"),
    ("where_nested", "brand ~= 1 or ( brand ~= 2 and original ~= ring )", "contains(p_brand, '1') OR (contains(p_brand, '2') AND contains(p_name, 'ring'))"),
    ("where_unknown_col", "color = red", "false"),
):
    register(_name, lambda spark, d, query=_query: tidy_part(spark, d, query), f"SELECT p_partkey::VARCHAR AS id, p_name AS original, p_type AS surface, p_brand AS brand FROM part WHERE {_sql}")
register(
    "where_map",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", wh.matches_map("segment = BUILDING or name ~= 7", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))).alias("hit")),
    "SELECT c_custkey, c_mktsegment = 'BUILDING' OR contains(c_name, '7') AS hit FROM customer",
)

# -- distances -------------------------------------------------------------------------------------

_FAR = {"ie": 24, "ou": 24, "ae": 32, "ao": 32, "iu": 40, "eo": 44, "au": 44, "ai": 48, "eu": 44, "io": 52}
LEX_SQL = f"""lex(kana, c, v) AS (VALUES {', '.join(f"({q(k)}, {q(c)}, {q(v)})" for k, (c, v) in lex.units().items())}),
feat(c, place, manner, voice) AS (VALUES {', '.join(f"({q(c)}, {a}, {b}, {d})" for c, (a, b, d) in lex._FEATURES.items())}),
far(a, b, d) AS (VALUES {', '.join(f"({q(x)}, {q(y)}, {d})" for k, d in _FAR.items() for x, y in (k, k[::-1]))}),
lx AS (SELECT kana, lex.c AS c, v, split_part(lex.c, '+', 1) AS cc, rtrim(v, ':') AS vr, CASE WHEN regexp_matches(rtrim(v, ':'), '[aeiou]$') THEN right(rtrim(v, ':'), 1) ELSE v END AS vq, place, manner, voice FROM lex JOIN feat ON feat.c = split_part(lex.c, '+', 1)),
dist AS (SELECT a.kana AS u1, b.kana AS u2, ((CASE WHEN a.cc = b.cc THEN 0 WHEN 'sp' IN (a.cc, b.cc) THEN 60 ELSE least(80, 4 * abs(a.place - b.place) + 12 * (a.manner <> b.manner)::INTEGER + 8 * (a.voice <> b.voice)::INTEGER + 4) END)
 + (CASE WHEN a.v = b.v THEN 0 ELSE least(80, (CASE WHEN length(a.vq) = 1 AND length(b.vq) = 1 AND strpos('aeiou', a.vq) > 0 AND strpos('aeiou', b.vq) > 0 THEN coalesce(far.d, 0) ELSE 60 END) + 4 * (left(a.vr, length(a.vr) - 1) <> left(b.vr, length(b.vr) - 1))::INTEGER + 20 * ((a.v LIKE '%:') <> (b.v LIKE '%:'))::INTEGER) END)) / 2.0::DOUBLE AS dist
 FROM lx a CROSS JOIN lx b LEFT JOIN far ON far.a = a.vq AND far.b = b.vq)"""
REWARD = {"SAME_KANA_REWARD": 0.5, "SAME_VOWEL_REWARD": 0.75, "SAME_CONSONANT_REWARD": 0.5, "SAME_HATSUON_REWARD": 0.25, "SAME_SOKUON_REWARD": 0.25, "SAME_BAR_REWARD": 0.1}

def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u1, u2, n): units that follow each other in the ways to say the document words, and how often."""
    after = F.when(F.size("units") > 1, F.transform(F.sequence(F.lit(0), F.size("units") - 2), lambda i: F.struct(F.get("units", i).alias("u1"), F.get("units", i + 1).alias("u2"))))
    return match_words(spark, sf_dir).select(F.explode(after).alias("p")).groupBy("p.u1", "p.u2").agg(F.count("*").alias("n"))


def pair_query(name: str, change: Callable[[DataFrame], DataFrame], columns: str) -> None:
    """A query over the unit pairs of the words, each with its distance; units that the matrix has not are left out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the distance table has a fixed size
        return change(unit_pairs(spark, sf_dir).join(F.broadcast(distance.unit_matrix(spark)), ["u1", "u2"]))

    register(name, run)
    _PAIR_SQL[name] = columns


#: Select lists of the pair queries' SQL, which needs the word table's.
_PAIR_SQL: dict[str, str] = {}
pair_query("kana_dist_build", lambda p: p.select("u1", "u2", "n", "dist"), "u1, u2, n, dist")
pair_query(
    "kana_dist_rewards",
    lambda p: distance.rewarded(p, REWARD).select("u1", "u2", "n", "dist"),
    f"u1, u2, n, dist * (CASE WHEN u1 = u2 THEN 0.5 ELSE 1 END) * (CASE WHEN {d_last_vowel('u1')} = {d_last_vowel('u2')} THEN 0.75 ELSE 1 END) * (CASE WHEN {d_consonant('u1')} = {d_consonant('u2')} THEN 0.5 ELSE 1 END) * (CASE WHEN u1 LIKE '%ン' AND u2 LIKE '%ン' THEN 0.25 ELSE 1 END) * (CASE WHEN u1 LIKE '%ッ' AND u2 LIKE '%ッ' THEN 0.25 ELSE 1 END) AS dist",
)
pair_query("scale_matrix", lambda p: distance.scaled(p.withColumnRenamed("dist", "d"), 1.6).select("u1", "u2", "n", F.round("d", 6).alias("dist")), "u1, u2, n, round(dist * 1.6, 6) AS dist")
_LIKE = {"kana": distance.same_kana, "vowel": distance.same_vowel, "consonant": distance.same_consonant, "bar": distance.same_bar, "hatsuon": distance.same_hatsuon, "sokuon": distance.same_sokuon}
pair_query(
    "same_vowel_pairs",
    lambda p: p.select("u1", "u2", *(f(F.col("u1"), F.col("u2")).alias(k) for k, f in _LIKE.items())),
    f"u1, u2, u1 = u2 AS kana, {d_last_vowel('u1')} = {d_last_vowel('u2')} AS vowel, {d_consonant('u1')} = {d_consonant('u2')} AS consonant, u1 LIKE '%ー' AND u2 LIKE '%ー' AS bar, u1 LIKE '%ン' AND u2 LIKE '%ン' AS hatsuon, u1 LIKE '%ッ' AND u2 LIKE '%ッ' AS sokuon",
)


def kana2vowel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of the document words' ways, how often each comes, and its vowel in kana."""
    units = match_words(spark, sf_dir).select(F.explode("units").alias("kana")).groupBy("kana").agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(lex.vowel_names().items()), "kana string, vowel string")
    return units.join(F.broadcast(names), "kana", "left")


register("kana2vowel", kana2vowel)
KANA2VOWEL_SQL = f"p(kana, v) AS (VALUES {', '.join(f'({q(k)}, {q(v[-1])})' for k, (_, v) in lex.phonons().items())}), pv AS (SELECT kana, CASE v WHEN 'a' THEN 'ア' WHEN 'i' THEN 'イ' WHEN 'u' THEN 'ウ' WHEN 'e' THEN 'エ' WHEN 'o' THEN 'オ' ELSE 'sp' END AS vowel FROM p), kv AS (SELECT kana || unnest(CASE WHEN kana IN ('ン', 'ッ', 'sp') THEN [''] WHEN vowel = 'エ' THEN ['', 'ー', 'イ'] WHEN vowel = 'オ' THEN ['', 'ー', 'ウ'] ELSE ['', 'ー'] END) AS kana, vowel FROM pv)"

# -- matching: benchmark words are the targets, document words the word list ----------------------------

WORD_ID = "CASE WHEN length(w) % 2 = 1 THEN CAST((ascii(w) * 31 + ascii(substr(w, 2, 1)) * 7 + length(w)) % 997 AS {t}) ELSE substr(w, 1, 4) END"


def match_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word table: several words share an id. seq numbers the ways in order of the words."""
    numbered = wordlist.with_row_index(romaji_words(table(spark, sf_dir, "documents")).select("w", "s").sort("w"), "r")
    ways = numbered.select("w", "r", F.posexplode(kana.ways(F.col("s"))).alias("k", "v"))
    return ways.select(F.expr(WORD_ID.format(t="STRING")).alias("id"), F.size("v.units").alias("n_units"), (F.col("r") * (1 << 32) + F.col("k")).alias("seq"), F.col("v.units").alias("units"), F.col("v.vcost").alias("vcost"))


def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return romaji_words(table(spark, sf_dir, "benchmark")).select(F.col("w").alias("target"), kana.syllable_split(F.col("s")).alias("syllables"))


VARIATION_COST = 4.0


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distance.nearest(match_targets(spark, sf_dir), match_words(spark, sf_dir), distance.unit_matrix(spark), VARIATION_COST)


_T = WAYS_SQL.replace("syl ", "tsyl ").replace("FROM syl", "FROM tsyl").replace("lv ", "tlv ").replace("FROM lv", "FROM tlv").replace("va AS", "tva AS").replace("FROM va", "FROM tva").replace("vv AS", "tvv AS").replace("FROM vv", "FROM tvv").replace("ve AS", "tve AS").replace("FROM deco", "FROM targets")
NEAREST_SQL = f"""WITH RECURSIVE {words_sql()}, {words_sql('benchmark', 'targets')}, {WAYS_SQL}, {_T}, {LEX_SQL}, {WAYS_RECURSIVE}, {WAYS_RECURSIVE.replace('ways', 'tways').replace(' ve ', ' tve ')},
num AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS r FROM deco),
wd AS (SELECT {WORD_ID.format(t='VARCHAR').replace('(w', '(x.w').replace(' w)', ' x.w)')} AS id, len(units) AS n_units, r * 4294967296 + row_number() OVER (PARTITION BY x.w ORDER BY ord) - 1 AS seq, units, cost AS vcost FROM ways x JOIN num ON num.w = x.w WHERE i = n - 1 AND len(units) > 0),
tg AS (SELECT w AS target, units AS a, cost AS va FROM tways WHERE i = n - 1 AND len(units) > 0),
pr AS (SELECT DISTINCT a, units AS b FROM (SELECT DISTINCT a FROM tg) JOIN (SELECT DISTINCT units FROM wd) ON len(a) = len(units)),
pu AS (SELECT a, b, unnest(a) AS u1, unnest(b) AS u2 FROM pr),
pd AS (SELECT a, b, sum(dist) AS d FROM pu JOIN dist USING (u1, u2) GROUP BY a, b HAVING count(*) = len(a)),
pw AS (SELECT target, id, n_units, seq, min(d + (va + vcost) * 4.0) AS sim FROM tg JOIN pd USING (a) JOIN wd ON wd.units = pd.b GROUP BY ALL),
best AS (SELECT target, id, sim, n_units, seq, first_value(n_units) OVER (PARTITION BY target, id ORDER BY n_units, seq) AS sn, first_value(seq) OVER (PARTITION BY target, id ORDER BY n_units, seq) AS ss FROM pw QUALIFY row_number() OVER (PARTITION BY target, id ORDER BY sim, n_units DESC, seq DESC) = 1),
rk AS (SELECT target, id, sim, n_units::INTEGER AS n_units, seq, row_number() OVER (PARTITION BY target ORDER BY sim, NOT regexp_full_match(id, '(0|[1-9][0-9]{{0,9}})'), coalesce(TRY_CAST(id AS BIGINT), 0), sn, ss)::INTEGER AS rank FROM best)"""
for _name, _columns in _PAIR_SQL.items():
    _SQL[_name] = NEAREST_SQL + f", up AS (SELECT units[i] AS u1, units[i + 1] AS u2, count(*) AS n FROM (SELECT units, unnest(range(1, len(units))) AS i FROM wd) GROUP BY ALL) SELECT {_columns} FROM up JOIN dist USING (u1, u2)"
_SQL["kana2vowel"] = NEAREST_SQL + f", {KANA2VOWEL_SQL}, un AS (SELECT unnest(units) AS kana FROM wd), uc AS (SELECT kana, count(*) AS n FROM un GROUP BY kana) SELECT kana, n, vowel FROM uc LEFT JOIN kv USING (kana)"
register("best_per_id", lambda spark, d: nearest(spark, d).select("target", "id", "sim", "n_units", "seq"), NEAREST_SQL + " SELECT target, id, sim, n_units, seq FROM rk")
register("topk_candidates", lambda spark, d: lattice.nearest(match_targets(spark, d), match_words(spark, d), distance.unit_matrix(spark), VARIATION_COST, 30).select("target", "id", "sim", "n_units", "seq", "rank"), NEAREST_SQL + " SELECT target, id, sim, n_units, seq, rank FROM rk WHERE rank <= 30")
register("rank_candidates", lambda spark, d: lattice.nearest(match_targets(spark, d), match_words(spark, d), distance.unit_matrix(spark), VARIATION_COST).select("target", "id", "rank"), NEAREST_SQL + " SELECT target, id, rank FROM rk")


def cand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words meet each target by the number of units of one of its ways, and the first: words are counted by that number before the join."""
    t = match_targets(spark, sf_dir).select("target", F.explode(F.array_distinct(F.transform(kana.variations(F.col("syllables")), lambda v: F.size(v["units"])))).alias("n_units"))
    sizes = match_words(spark, sf_dir).groupBy("n_units").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return t.join(sizes, "n_units").select("target", "n_units", "n", "first")


register(
    "cand_join",
    cand_join,
    NEAREST_SQL + ", t AS (SELECT DISTINCT target, len(a) AS n_units FROM tg) SELECT target, n_units::INTEGER AS n_units, count(*) AS n, min(seq) AS first FROM t JOIN wd USING (n_units) GROUP BY target, n_units",
)


def queries() -> dict[str, Query]:
    from . import queries_more  # noqa: F401  registers the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
