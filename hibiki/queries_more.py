"""Further registered queries: aggregates, order-dependent operators, token repair, alignment, segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import english, kana, ruby
from .functions import lexicon as lex
from .operators import align, distance, lattice, segment, tokens
from .sources import text
from .queries import NEAREST_SQL, VARIATION_COST, d_last_vowel, joined, match_targets, match_words, q, register, romaji_words, sql_map, table

# -- aggregates on arrays ------------------------------------------------------------------------

D_W = "list_transform(embedding, lambda x: x::DOUBLE)"
register(
    "normalize_weights",
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("positive"), F.transform("embedding", lambda x: x.cast("double")).alias("w")).select("vec_id", "positive", F.when(F.col("positive") == 1, F.transform("w", lambda x: F.abs(x))).otherwise(F.col("w")).alias("w")).select("vec_id", "positive", F.round(F.aggregate(distance.normalized_weights(F.col("w"), F.size("w")), F.lit(0.0), lambda a, x: F.greatest(a, x)), 6).alias("largest")),
    f"WITH t AS (SELECT vec_id, unnest([0, 1])::INTEGER AS positive, {D_W} AS w0 FROM embeddings), u AS (SELECT vec_id, positive, CASE WHEN positive = 1 THEN list_transform(w0, lambda x: abs(x)) ELSE w0 END AS w FROM t) SELECT vec_id, positive, CASE WHEN list_min(w) >= 0 AND list_sum(w) > 0 THEN round(list_max(w) * len(w) / list_sum(w), 6) END AS largest FROM u",
)
register("argmin", lambda spark, d: table(spark, d, "embeddings").select("vec_id", distance.argmin(F.col("embedding")).alias("at")), "SELECT vec_id, (list_position(embedding, list_min(embedding)) - 1)::INTEGER AS at FROM embeddings")
register(
    "argsort",
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", joined(distance.argsort(F.transform("embedding", lambda x: F.rint(x * 4))).cast("array<string>")).alias("order")),
    "WITH t AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), u AS (SELECT vec_id, round_even(x::DOUBLE * 4, 0) AS x, i FROM t) SELECT vec_id, string_agg(i::VARCHAR, '|' ORDER BY x, i) AS order FROM u GROUP BY vec_id".replace(" AS order", ' AS "order"'),
)
register(
    "find_min",
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.lit(float("inf"))).otherwise(F.col("l_quantity").cast("double")).alias("x")).groupBy("l_orderkey").agg(distance.find_min(F.col("x"), F.col("l_linenumber")).alias("m")).select("l_orderkey", F.col("m.at").alias("at"), F.col("m.value").alias("least")),
    "WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 25 THEN l_quantity::DOUBLE END AS x FROM lineitem) SELECT l_orderkey, CASE WHEN x IS NOT NULL THEN l_linenumber END AS at, x AS least FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY x NULLS LAST, l_linenumber) = 1",
)
register("org_round", lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", distance.org_round(F.col("l_quantity") * 0.25, 2).alias("out")), "SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.25 * 2, 0) / 2 AS out FROM lineitem")
register(
    "product",
    lambda spark, d: table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", F.posexplode(distance.product(F.array(F.array("r_name", F.lit("x")), F.array(F.col("n_name"), F.lit("y"), F.lit("z")), F.array("r_name")))).alias("i", "p")).select("r_name", "n_name", F.col("i").cast("long").alias("i"), joined(F.col("p")).alias("p")),
    "WITH t AS (SELECT r_name, n_name, unnest([r_name, 'x']) AS a, unnest([0, 1]) AS i FROM region JOIN nation ON r_regionkey = n_regionkey), u AS (SELECT r_name, n_name, a, i, unnest([n_name, 'y', 'z']) AS b, unnest([0, 1, 2]) AS j FROM t) SELECT r_name, n_name, (i * 3 + j)::BIGINT AS i, a || '|' || b || '|' || r_name AS p FROM u",
)


def target_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's different ways."""
    return match_targets(spark, sf_dir).select("target", F.explode(F.array_distinct(kana.variations(F.col("syllables"))["units"])).alias("a"))


def distances(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    """Targets' ways against all words' ways, of equal ways of targets one; weighted by 1, 2, 3 ... along the units."""
    w = match_words(spark, sf_dir).select("units").distinct()
    t = target_ways(spark, sf_dir)
    pairs = t.select("a").distinct().join(w, F.size("a") == F.size("units")).select("a", F.col("units").alias("b"))
    if weighted:
        pairs = pairs.withColumn("w", distance.normalized_weights(F.sequence(F.lit(1), F.size("a")).cast("array<double>"), F.size("a")))
    return t.join(distance.pair_distances(pairs, distance.unit_matrix(spark), ["a", "b"], weighted), "a")


def _near_sql() -> str:
    return NEAREST_SQL + ", one AS (SELECT DISTINCT target, a FROM tg)"


register("word_distance", lambda spark, d: distances(spark, d).groupBy("target").agg(F.min("d").alias("least"), F.count("*").alias("n"), F.sum("d").alias("total")), _near_sql() + " SELECT target, min(d) AS least, count(*) AS n, sum(d) AS total FROM one JOIN pd USING (a) GROUP BY target")
register(
    "weighted_distance",
    lambda spark, d: distances(spark, d, True).groupBy("target").agg(F.round(F.min("d"), 6).alias("least")),
    _near_sql() + ", wu AS (SELECT a, b, unnest(a) AS u1, unnest(b) AS u2, unnest(range(1, len(a) + 1)) AS k, len(a) AS n FROM pr), wp AS (SELECT a, b, sum(dist * k * n / (n * (n + 1) / 2.0)) AS d FROM wu JOIN dist USING (u1, u2) GROUP BY a, b, n HAVING count(*) = n) SELECT target, round(min(d), 6) AS least FROM one JOIN wp USING (a) GROUP BY target",
)
register(
    "nearest_weighted",
    lambda spark, d: lattice.nearest(match_targets(spark, d), match_words(spark, d), distance.unit_matrix(spark), VARIATION_COST, 1, F.transform(F.col("syllables"), lambda s, i: (i + 1).cast("double"))).select("target", F.round("sim", 6).alias("sim")),
    NEAREST_SQL
    + """, ts AS (SELECT w AS target, units AS a, cost AS va, src, n FROM tways WHERE i = n - 1 AND len(units) > 0),
nx AS (SELECT target, a, va, unnest(a) AS u1, unnest(src) + 1 AS k, unnest(range(len(a))) AS j, n FROM ts),
nw AS (SELECT DISTINCT units AS b, len(units) AS m FROM wd), nb AS (SELECT b, m, unnest(b) AS u2, unnest(range(m)) AS j FROM nw),
ng AS (SELECT target, a, nx.va, b, sum(dist * k * n / (n * (n + 1) / 2.0)) AS d FROM nx JOIN nb ON nb.m = len(nx.a) AND nb.j = nx.j JOIN dist ON dist.u1 = nx.u1 AND dist.u2 = nb.u2 GROUP BY target, a, nx.va, b, m HAVING count(*) = m)
SELECT target, round(min(d + (ng.va + vcost) * 4.0), 6) AS sim FROM ng JOIN wd ON wd.units = ng.b GROUP BY target""",
)
register(
    "unit_distance",
    lambda spark, d: target_ways(spark, d).select("target", joined(F.col("a")).alias("way"), F.posexplode("a").alias("i", "u1")).select("target", "way", F.col("i").cast("long").alias("i"), "u1", kana.kana_vowel(F.col("u1")).alias("u2")).join(F.broadcast(distance.unit_matrix(spark)), ["u1", "u2"], "left").select("target", "way", "i", F.coalesce("dist", F.lit(float("inf"))).alias("dist")),
    _near_sql() + ", x AS (SELECT target, array_to_string(a, '|') AS way, unnest(range(len(a))) AS i, unnest(a) AS u1 FROM one) SELECT target, way, i, coalesce(dist, 'inf'::DOUBLE) AS dist FROM x LEFT JOIN dist ON dist.u1 = x.u1 AND dist.u2 = " + d_last_vowel("x.u1"),
)


def ways_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ways = match_targets(spark, sf_dir).select("target", F.explode(kana.variations(F.col("syllables"))).alias("v")).select("target", F.col("v.units").alias("a"), F.col("v.vcost").alias("va"))
    w = match_words(spark, sf_dir).select("units", "vcost", "n_units")
    pairs = ways.select("a").distinct().join(w.select("units", "n_units").distinct(), F.size("a") == F.col("n_units")).select("a", F.col("units").alias("b"))
    scored = distance.pair_distances(pairs, distance.unit_matrix(spark), ["a", "b"])
    return ways.join(scored, "a").join(w.withColumnRenamed("units", "b"), "b").select("target", "b", (F.col("d") + (F.col("va") + F.col("vcost")) * VARIATION_COST).alias("sim"))


register("min_over_variations", lambda spark, d: ways_scored(spark, d).groupBy("target").agg(F.min("sim").alias("sim")), _near_sql() + " SELECT target, min(sim) AS sim FROM pw GROUP BY target")
register("variation_cost", lambda spark, d: ways_scored(spark, d).groupBy("target").agg(F.sum("sim").alias("total"), F.count("*").alias("n")), _near_sql() + " SELECT target, sum(d + (va + vcost) * 4.0) AS total, count(*) AS n FROM tg JOIN pd USING (a) JOIN wd ON wd.units = pd.b GROUP BY target")
register(
    "expand_weights",
    lambda spark, d: match_targets(spark, d).select("target", F.size("syllables").alias("n"), F.posexplode(kana.variations(F.col("syllables"))).alias("k", "v")).select("target", F.col("k").cast("long").alias("ordinal"), joined(distance.expanded_weights(F.col("v.src"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i * 10 + 1)).cast("array<string>")).alias("w")),
    _near_sql() + " SELECT w AS target, row_number() OVER (PARTITION BY w ORDER BY ord) - 1 AS ordinal, array_to_string(list_transform(src, lambda k: k * 10 + 1), '|') AS w FROM tways WHERE i = n - 1 AND len(units) > 0",
)

# -- order-dependent operators ----------------------------------------------------------------------
# Conversations stand in for lines of tokens: a word's part of speech and reading follow its length.

POS = ["名詞", "助詞", "動詞", "記号", "副詞", "助動詞"]


def token_lines(spark: SparkSession, sf_dir: str, surface=lambda w: w, reading=lambda w: F.concat(F.lit("x"), w)) -> DataFrame:
    """(conv_id, turn, tokens) of every turn."""
    c = table(spark, sf_dir, "conversations")
    blank = {"basic_form": "*", "reading": "*", "pos_detail_2": "*", "pos_detail_3": "*", "conjugated_form": "*", "conjugated_type": "*"}

    def token(w: Column) -> Column:
        n = F.length(w)
        values = {"surface_form": surface(w), "pronunciation": reading(w), "pos": F.element_at(F.array(*map(F.lit, POS)), n % 6 + 1), "pos_detail_1": F.when(n % 5 == 0, F.lit("サ変接続")).otherwise(F.lit("一般")), "word_position": F.lit(1), "phrase": F.lit(0), "ruby": n % 11 == 0} | {k: F.lit(v) for k, v in blank.items()}
        return F.struct(*(values[k].alias(k) for k in (f.split(":")[0] for f in tokens.TOKEN[7:-1].split(",")))).cast(tokens.TOKEN)

    return c.select("conv_id", "turn", F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), 0), token).alias("tokens"))


TOKENS_SQL = f"""tk AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[^ \\t-\\r]+'), lambda w: {{'s': SURFACE, 'r': READING, 'p': ([{', '.join(map(q, POS))}])[length(w) % 6 + 1], 'd': CASE WHEN length(w) % 5 = 0 THEN 'サ変接続' ELSE '一般' END, 'y': length(w) % 11 = 0}}) AS t FROM conversations)"""


def field(name: str):
    return lambda x: F.coalesce(x[name].cast("string"), F.lit(""))


def on_tokens(name, repair, fields, sql_body, surface=lambda w: w, reading=lambda w: F.concat(F.lit("x"), w), d_surface="w", d_reading="'x' || w"):
    """A query of one repair: the named fields of all tokens, joined. sql_body: a list of structs from the token list t."""

    def run(spark, sf_dir):
        out = repair(F.col("tokens"))
        return token_lines(spark, sf_dir, surface, reading).select("conv_id", "turn", out.alias("t")).select("conv_id", "turn", *(joined(F.transform("t", field(f))).alias(f) for f in fields))

    short = {"surface_form": "s", "pronunciation": "r", "pos": "p"}
    head = TOKENS_SQL.replace("SURFACE", d_surface).replace("READING", d_reading)
    sql = sql_body and f"WITH {head}, o AS (SELECT conv_id, turn, {sql_body} AS t FROM tk) SELECT conv_id, turn, " + ", ".join(f"array_to_string(list_transform(t, lambda x: x.{short[f]}), '|') AS {f}" for f in fields) + " FROM o"
    register(name, run, sql)


def d_struct(s="x.s", r="x.r", p="x.p"):
    return f"{{'s': {s}, 'r': {r}, 'p': {p}, 'd': x.d, 'y': x.y}}"


def d_each(**change):
    return f"list_transform(t, lambda x: {d_struct(**change)})"


def coded(w, to: str, n: int = 10):
    return F.element_at(F.array(*map(F.lit, to.split("_"))), F.length(w) % n + 1)


def d_coded(to: str, n: int = 10) -> str:
    return f"([{', '.join(map(q, to.split('_')))}])[length(w) % {n} + 1]"


on_tokens("sign_reading", tokens.sign_reading, ["pronunciation"], d_each(r="CASE WHEN x.p = '記号' THEN x.s ELSE x.r END"))
on_tokens("unknown_sahen", tokens.unknown_sahen, ["pos", "pronunciation"], d_each(p="CASE WHEN x.p = '名詞' AND x.d = 'サ変接続' AND x.r = '' THEN '記号' ELSE x.p END"), reading=lambda w: F.when(F.length(w) % 4 == 0, w).otherwise(F.lit("")), d_reading="CASE WHEN length(w) % 4 = 0 THEN w ELSE '' END")
DIGITS = "1_a_7_9_0_12_x_3_4_5"
on_tokens("digit_reading", tokens.digit_reading, ["pronunciation"], d_each(r=f"CASE WHEN NOT x.y AND regexp_full_match(x.s, '[0-9]') THEN ({sql_map(tokens.DIGITS)})[x.s] ELSE x.r END"), surface=lambda w: coded(w, DIGITS), d_surface=d_coded(DIGITS))
KANA = "ひと_ー_カー_ェ_シ_日本_ー_ょ_き_ア"
on_tokens(
    "kana_surface",
    tokens.kana_surface,
    ["pos", "pronunciation"],
    d_each(r=f"CASE WHEN NOT x.y AND regexp_full_match(x.s, '[ぁ-ゔァ-ヴー]+') THEN translate(x.s, '{kana.HIRA}', '{kana.KATA}') ELSE x.r END", p="CASE WHEN NOT x.y AND regexp_full_match(x.s, '[ぁ-ゔァ-ヴー]+') AND x.p = '記号' THEN '名詞' ELSE x.p END"),
    surface=lambda w: coded(w, KANA),
    d_surface=d_coded(KANA),
)
_NEXT_BAR = "(i < len(t) AND NOT x.y AND NOT t[i + 1].y AND t[i + 1].s = 'ー')"
on_tokens(
    "merge_bar",
    tokens.merge_bar,
    ["surface_form", "pronunciation"],
    "list_filter(list_transform(t, lambda x, i: {'s': CASE WHEN %s THEN x.s || 'ー' ELSE x.s END, 'r': CASE WHEN %s THEN x.r || 'ー' ELSE x.r END, 'p': x.p, 'd': x.d, 'y': x.y}), lambda x: x.y OR x.s <> 'ー')" % (_NEXT_BAR, _NEXT_BAR),
    surface=lambda w: coded(w, KANA),
    d_surface=d_coded(KANA),
)
_SMALL = "'^[ぁぃぅぇぉゃゅょゎっァィゥェォヮャュョッ]'"
_JOINS = "(NOT a.y AND NOT b.y AND regexp_matches(b.s, %s) AND regexp_matches(a.s, '[ぁ-ゔァ-ヴ]$'))" % _SMALL
_J_NEXT = "(i < len(t) AND " + _JOINS.replace("a.", "x.").replace("b.", "t[i + 1].") + ")"
_J_OWN = "(i > 1 AND " + _JOINS.replace("a.", "t[i - 1].").replace("b.", "x.") + ")"
on_tokens(
    "merge_small_kana",
    tokens.merge_small_kana,
    ["surface_form", "pronunciation"],
    f"list_filter(list_transform(t, lambda x, i: {{'s': CASE WHEN {_J_NEXT} THEN x.s || t[i + 1].s ELSE x.s END, 'r': CASE WHEN {_J_NEXT} THEN x.r || t[i + 1].r ELSE x.r END, 'p': x.p, 'g': {_J_OWN}}}), lambda x: NOT x.g)",
    surface=lambda w: coded(w, KANA),
    d_surface=d_coded(KANA),
)
on_tokens("residual_sign", tokens.residual_sign, ["pos"], d_each(p="CASE WHEN x.r = '*' THEN '記号' ELSE x.p END"), reading=lambda w: F.when(F.length(w) % 2 == 0, F.lit("*")).otherwise(w), d_reading="CASE WHEN length(w) % 2 = 0 THEN '*' ELSE w END")
MIXED = "ひらがな_カタカナー_!ねこ!_a_〜ら_山_・ト_ 「ア」_ー_々"
_CLEAN = f"translate(regexp_replace(translate(x.s, {q(kana.WIDE)}, {q(kana.NARROW)}), '[{kana.SIGNS}{kana.SPACE}・「」。、]', '', 'g'), '{kana.HIRA}', '{kana.KATA}')"
on_tokens("kana_reading", tokens.kana_reading, ["pronunciation"], d_each(r=f"CASE WHEN x.r = '*' AND regexp_full_match({_CLEAN}, '[　-〜ァ-ヶ・-ヾ]+') THEN {_CLEAN} ELSE x.r END"), surface=lambda w: coded(w, MIXED), d_surface=d_coded(MIXED), reading=lambda w: F.lit("*"), d_reading="'*'")
on_tokens("kanji_reading", tokens.kanji_reading, ["pronunciation"], d_each(r=f"CASE WHEN x.r = '*' AND x.s = '山' THEN 'サン' ELSE x.r END"), surface=lambda w: coded(w, MIXED), d_surface=d_coded(MIXED), reading=lambda w: F.lit("*"), d_reading="'*'")
LATIN = "love_CAT_shinbun_itAPOSTROPHEs_日_Bq_dog_a1_X_ring"
on_tokens("english_reading", tokens.english_reading, ["surface_form", "pronunciation"], None, surface=lambda w: coded(w, LATIN))
SAID = "ハ_ァ_シ_ェ_ウッセ_ィ_ス_ゥ_フ_ォー"
on_tokens("absorb_tokens", tokens.absorb_tokens, ["pronunciation"], None, reading=lambda w: coded(w, SAID))
on_tokens("format_tokens", tokens.format_tokens, ["surface_form", "pronunciation", "pos", "phrase"], None, surface=lambda w: coded(w, KANA + "_love_3_山", 13))
register(
    "phrase_index",
    lambda spark, d: token_lines(spark, d).select("conv_id", "turn", joined(F.transform(tokens.phrase_index(F.col("tokens")), lambda t: t["phrase"].cast("string"))).alias("phrase")),
    f"""WITH {TOKENS_SQL.replace('SURFACE', 'w').replace('READING', 'w')}, e AS (SELECT conv_id, turn, unnest(list_transform(t, lambda x: x.p)) AS p, unnest(range(len(t))) AS i FROM tk),
c AS (SELECT conv_id, turn, i, sum(CASE WHEN i > 0 AND p IN ({', '.join(map(q, tokens.PHRASE_POS))}) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM e),
g AS (SELECT conv_id, turn, string_agg(n::BIGINT::VARCHAR, '|' ORDER BY i) AS phrase FROM c GROUP BY ALL) SELECT tk.conv_id, tk.turn, coalesce(phrase, '') AS phrase FROM tk LEFT JOIN g USING (conv_id, turn)""",
)
register(
    "phrase_breaks",
    lambda spark, d: token_lines(spark, d).select("conv_id", "turn", joined(segment.phrase_breaks(F.transform(tokens.phrase_index(F.col("tokens")), lambda t: t["phrase"])).cast("array<string>")).alias("breaks")),
    f"""WITH {TOKENS_SQL.replace('SURFACE', 'w').replace('READING', 'w')}, e AS (SELECT conv_id, turn, unnest(list_transform(t, lambda x: x.p)) AS p, unnest(range(len(t))) AS i FROM tk),
g AS (SELECT conv_id, turn, string_agg(i::VARCHAR, '|' ORDER BY i) AS breaks FROM e WHERE i = 0 OR p IN ({', '.join(map(q, tokens.PHRASE_POS))}) GROUP BY ALL) SELECT tk.conv_id, tk.turn, coalesce(breaks, '') AS breaks FROM tk LEFT JOIN g USING (conv_id, turn)""",
)
register(
    "word_position",
    lambda spark, d: token_lines(spark, d).select("conv_id", "turn", joined(tokens.word_positions(F.transform("tokens", lambda t: t["surface_form"])).cast("array<string>")).alias("place")),
    """WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \\t-\\r]+') AS a FROM conversations), e AS (SELECT conv_id, turn, unnest(a) AS x, unnest(range(len(a))) AS i FROM w),
p AS (SELECT conv_id, turn, i, 1 + coalesce(sum(length(x)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e),
g AS (SELECT conv_id, turn, string_agg(n::BIGINT::VARCHAR, '|' ORDER BY i) AS place FROM p GROUP BY ALL) SELECT w.conv_id, w.turn, coalesce(place, '') AS place FROM w LEFT JOIN g USING (conv_id, turn)""",
)
register("yomi_concat", lambda spark, d: token_lines(spark, d, reading=lambda w: w).select("conv_id", "turn", tokens.yomi(F.col("tokens")).alias("yomi")), f"WITH w AS (SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[^ \\t-\\r]+'), lambda w: w), '') AS x FROM conversations) SELECT conv_id, turn, regexp_replace(translate(x, {q(kana.WIDE)}, {q(kana.NARROW)}), '[{kana.SIGNS}{kana.SPACE}・「」。、]', '', 'g') AS yomi FROM w")


def js_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from .sources.wordlist import id_order

    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("k"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("id"))
    seen = p.groupBy("p_brand", "id").agg(F.min("p_partkey").alias("seen"))
    return seen.select("p_brand", "id", F.row_number().over(Window.partitionBy("p_brand").orderBy(*id_order(F.col("id"), F.col("seen")))).alias("place"))


register("js_key_order", js_key_order, "WITH t AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'k' || p_size ELSE p_size::VARCHAR END AS id, min(p_partkey) AS seen FROM part GROUP BY ALL) SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY TRY_CAST(id AS BIGINT) IS NULL, coalesce(TRY_CAST(id AS BIGINT), 0), seen)::INTEGER AS place FROM t")


# -- ruby and alignment ---------------------------------------------------------------------------------

MARKED = "CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN '｜' || p_name || '《ひら》' || p_type WHEN 2 THEN p_name || '|' || p_type || '《' || p_brand || '》' WHEN 3 THEN '｜' || p_name || '《》' ELSE '｜' || p_name || '｜' || p_type || '《よみ》x' END"


def ruby_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(MARKED).alias("x"))


def ruby_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ruby_rows(spark, sf_dir).select("p_partkey", ruby.ruby_parse(F.col("x")).alias("r")).select("p_partkey", "r.plain", joined(F.transform("r.annotations", lambda a: F.concat_ws(":", a["start"].cast("string"), a["end"].cast("string"), a["reading"]))).alias("marks"))


register(
    "ruby_parse",
    ruby_parse,
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || p_type WHEN 2 THEN p_name || p_type WHEN 3 THEN '｜' || p_name || '《》' ELSE '｜' || p_name || p_type || 'x' END AS plain,
CASE p_size % 5 WHEN 1 THEN '0:' || length(p_name) || ':ヒラ' WHEN 2 THEN length(p_name) || ':' || length(p_name || p_type) || ':' || p_brand WHEN 4 THEN length(p_name) + 1 || ':' || length(p_name || p_type) + 1 || ':ヨミ' ELSE '' END AS marks FROM part""",
)
register("has_ruby", lambda spark, d: ruby_rows(spark, d).select("p_partkey", ruby.has_ruby(F.col("x")).alias("hit")), "SELECT p_partkey, p_size % 5 IN (1, 2, 4) AS hit FROM part")
register(
    "ruby_split",
    lambda spark, d: ruby_rows(spark, d).select("p_partkey", joined(F.transform(ruby.ruby_split(F.col("x")), lambda p: F.concat_ws("=", p["type"], p["surface"], p["reading"]))).alias("pieces")),
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'chunk=' || p_name WHEN 1 THEN 'ruby=' || p_name || '=ヒラ|chunk=' || p_type WHEN 2 THEN 'chunk=' || p_name || '|ruby=' || p_type || '=' || p_brand WHEN 3 THEN 'chunk=｜' || p_name || '《》' ELSE 'chunk=｜' || p_name || '|ruby=' || p_type || '=ヨミ|chunk=x' END AS pieces FROM part",
)
register(
    "balanced_allocate",
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.posexplode(tokens.balanced(F.col("p_brand"), F.col("p_name"))).alias("i", "x")).select("p_partkey", F.col("i").cast("long").alias("i"), "x.*"),
    """WITH t AS (SELECT p_partkey, p_brand AS s, p_name AS r, least(length(p_brand), length(p_name)) AS k FROM part), u AS (SELECT *, unnest(range(k)) AS j FROM t),
v AS (SELECT *, greatest(length(s), length(r)) // k AS b, greatest(length(s), length(r)) % k AS e FROM u), w AS (SELECT *, j * b + least(j, e) AS o0, b + (j < e)::INTEGER AS n FROM v),
a AS (SELECT p_partkey, s[j + 1] AS surface_form, unnest(range(n)) AS o, r, o0, j FROM w WHERE length(s) <= length(r)),
z AS (SELECT p_partkey, j, surface_form, r[o0 + o + 1] AS pronunciation, o::INTEGER AS in_surface_pos FROM a UNION ALL SELECT p_partkey, j, substr(s, o0 + 1, n), r[j + 1], 0 FROM w WHERE length(s) > length(r))
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY j, in_surface_pos) - 1 AS i, surface_form, pronunciation, in_surface_pos FROM z""",
)
RUNS_TEXT = "translate(p_name, 'abcdefghij', 'アぁカきー日本花ッん')"
register(
    "kana_runs",
    lambda spark, d: table(spark, d, "part").select("p_partkey", joined(F.transform(tokens.kana_runs(F.expr(RUNS_TEXT)), lambda x: F.concat_ws(":", x["surface_form"], x["type"]))).alias("runs")),
    f"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all({RUNS_TEXT}, '[ァ-ヴー]+|[ぁ-ゔー]+|[^ぁ-ゔァ-ヴー]+'), lambda x: x || ':' || CASE WHEN regexp_matches(x, '^[ァ-ヴー]') THEN 'kata' WHEN regexp_matches(x, '^[ぁ-ゔ]') THEN 'hira' ELSE 'nonkana' END), '|') AS runs FROM part",
)
register("kana_allocate", lambda spark, d: table(spark, d, "part").select("p_partkey", joined(F.transform(align.kana_pairs(F.expr(RUNS_TEXT), F.translate(F.expr(RUNS_TEXT), kana.HIRA, kana.KATA)), lambda p: F.concat_ws(":", p["surface"], p["reading"], p["type"]))).alias("pairs")))
register("kanji_allocate", lambda spark, d: table(spark, d, "part").select("p_partkey", joined(F.transform(align.kanji_pairs(F.translate("p_name", "abcdefghij", "山川東京日本花火大小"), F.lit("サンヒガシトウニチカワモトハナ")), lambda p: F.concat_ws(":", p["surface"], p["reading"]))).alias("pairs")))


def merge_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("p_name", " "), lambda w, i: F.struct(w.alias("surface_form"), F.when((F.length(w) + i) % 2 == 0, F.lit("sign")).otherwise(F.lit("kana")).alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", joined(F.transform(tokens.merge_sign(rows), lambda t: t["surface_form"])).alias("out"))


register(
    "merge_sign",
    merge_sign,
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part), e AS (SELECT p_partkey, unnest(a) AS w, unnest(range(len(a))) AS i FROM t),
f AS (SELECT *, (length(w) + i) % 2 = 0 AS sign FROM e), g AS (SELECT *, sum((NOT sign)::INTEGER) OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM f),
h AS (SELECT p_partkey, k, string_agg(w, '' ORDER BY i) AS s FROM g WHERE k > 0 GROUP BY ALL), j AS (SELECT p_partkey, string_agg(s, '|' ORDER BY k) AS out FROM h GROUP BY 1)
SELECT p_partkey, coalesce(out, '') AS out FROM t LEFT JOIN j USING (p_partkey)""",
)


# -- conversations as songs, turns as lines ------------------------------------------------------------------------


def kana_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song, line, tokens) of every turn: its romaji words as kana tokens; each begins a phrase by its length."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("song"), F.col("turn").alias("line"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("ws"))
    found = F.filter("ws", english.is_romaji)
    return c.select("song", "line", F.transform(found, lambda w: F.struct(w.alias("surface_form"), english.romaji_words_to_kana(w).alias("pronunciation"), F.element_at(F.array(*map(F.lit, POS)), F.length(w) % 6 + 1).alias("pos"), F.lit(0).alias("phrase"))).alias("tokens"))


register("align_line", lambda spark, d: kana_lines(spark, d).select("song", "line", F.posexplode(align.align_line(F.col("tokens"))).alias("i", "u")).select("song", "line", "i", "u.*"))


register(
    "char_index",
    lambda spark, d: align.with_pieces(kana_lines(spark, d)).select("song", "line", F.posexplode("pieces").alias("k", "p")).select("song", "line", "k", "p.reading", "p.token", "p.subword", "p.char_index"),
    # a Latin word gives one part, whose kana are never more than its letters: each reading character is a character of its own
    f"""WITH t AS (SELECT conv_id AS song, turn AS line, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: regexp_full_match(w, '{lex.romaji_pattern()}+')) AS ws FROM conversations),
u AS (SELECT song, line, unnest(ws) AS w, unnest(range(len(ws))) AS token FROM t),
r AS (SELECT song, line, token, length(w) % 6 = 3 AS sign, array_to_string(list_transform(regexp_extract_all(w, '{lex.romaji_pattern()}'), lambda k: ({sql_map(lex.romaji())})[k]), '') AS said FROM u),
c AS (SELECT song, line, token, sign, said, unnest(range(1, length(said) + 1)) AS j FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY song, line ORDER BY token, j) - 1 AS char_index FROM c)
SELECT song, line, (row_number() OVER (PARTITION BY song, line ORDER BY token, j) - 1)::INTEGER AS k, said[j] AS reading, token::INTEGER AS token, token::INTEGER AS subword, char_index::INTEGER AS char_index FROM n WHERE NOT sign""",
)


def song_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(song, line, units, surfaces, breaks) of every turn."""
    from .plans.store import stored

    numbers = tokens.phrase_numbers(F.transform("tokens", lambda t: t["pos"]))
    toks = F.zip_with("tokens", numbers, lambda t, p: t.withField("phrase", p))
    units = stored(kana_lines(spark, sf_dir).select("song", "line", align.align_line(toks).alias("u")))
    each = lambda f: F.transform("u", lambda x: x[f])
    return units.select("song", "line", each("pronunciation").alias("units"), each("surface_form").alias("surfaces"), segment.phrase_breaks(each("phrase")).alias("breaks"))


def covered(spark: SparkSession, sf_dir: str, lines: DataFrame, **parameters) -> DataFrame:
    return lattice.generate(lines, match_words(spark, sf_dir), distance.unit_matrix(spark), {"VARIATION_COST": VARIATION_COST} | parameters)


def segment_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for every turn, which may repeat."""
    return covered(spark, sf_dir, song_lines(spark, sf_dir)).select("song", "line", "word", "i", "t", "filler", "score")


def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for every turn, none twice in a conversation."""
    return covered(spark, sf_dir, song_lines(spark, sf_dir), DUPLICATE=False)


def generate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """generate with weights that fall along each line; every third line's are not valid and count as none."""
    n = F.size("units")
    weights = F.when((F.col("line") % 3 != 0) & (n > 0), F.transform(F.sequence(F.lit(1), n), lambda k: (n - k + 1).cast("double")))
    return covered(spark, sf_dir, song_lines(spark, sf_dir).withColumn("weights", weights), DUPLICATE=False)


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """generate with the first two units of every line pinned."""
    pin = F.array(F.struct(F.lit(0).alias("i"), F.lit(2).alias("t"), F.concat(F.lit("pin"), F.col("line").cast("string")).alias("id"), F.lit(0.0).alias("sim")))
    lines = song_lines(spark, sf_dir).withColumn("locks", F.when(F.size("units") >= 2, pin))
    return covered(spark, sf_dir, lines, DUPLICATE=False)


def no_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word comes in a conversation: once."""
    return generate(spark, sf_dir).where("NOT filler").groupBy("song", "id").agg(F.count("*").alias("n"))


def filler_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose units no word can match, whole words of the line here: every one is filler."""
    lines = kana_lines(spark, sf_dir).select("song", "line", F.transform("tokens", lambda t: F.concat(F.lit("?"), t["pronunciation"])).alias("units"))
    cost = covered(spark, sf_dir, lines).groupBy("song", "line").agg(F.sum(F.col("score") + 1).alias("cost"))
    return lines.join(cost, ["song", "line"], "left").select("song", "line", F.coalesce("cost", F.lit(0.0)).alias("cost"))


# -- raw text: conversations with a ruby span in front of every third turn ----------------------------------------

RUBY_TEXT = "CASE WHEN turn % 3 = 0 THEN concat('｜', role, '《', 'ヨミ》', text) ELSE text END"


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(RUBY_TEXT).alias("text"))
    return text.with_tokens(t, F.col("text"), out="t").select("conv_id", "turn", "t")


def tokenize_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's repaired tokens by character, its ruby span as one."""
    t = text_tokens(spark, sf_dir).select("conv_id", "turn", tokens.format_tokens(F.col("t")).alias("t"))
    return t.select("conv_id", "turn", *(joined(F.transform("t", field(f))).alias(f) for f in ("surface_form", "pronunciation", "phrase")))


register("tokenize_together", tokenize_together)


def english_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every part's name, its Latin words with kana readings."""
    t = text.with_english_tokens(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), text.Words, out="t")
    return t.select("p_partkey", *(joined(F.transform("t", field(f))).alias(f) for f in ("surface_form", "pronunciation")))


register("english_line", english_line)
register(
    "merge_ruby",
    lambda spark, d: text_tokens(spark, d).select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0))["surface_form"].alias("first"), F.coalesce(F.get("t", F.lit(0))["ruby"], F.lit(False)).alias("ruby"), F.element_at("t", -1)["word_position"].cast("long").alias("place")),
    """WITH t AS (SELECT conv_id, turn, role, replace(replace(text, '’', chr(39)), chr(39), 'APOSTROPHE') AS x FROM conversations)
SELECT conv_id, turn, (length(x) + (turn % 3 = 0)::INTEGER)::BIGINT AS n, CASE WHEN turn % 3 = 0 THEN role ELSE left(x, 1) END AS first, turn % 3 = 0 AS ruby, CASE WHEN turn % 3 = 0 THEN length(role) + length(x) ELSE length(x) END::BIGINT AS place FROM t""",
)
register("segment_dp", segment_dp)
register("generate", generate)
register("generate_weighted", generate_weighted)
register("no_reuse", no_reuse)
register("locks", locks)
register(
    "filler_fallback",
    filler_fallback,
    "SELECT conv_id AS song, turn AS line, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: regexp_full_match(w, '%s+'))) * 1000001.0::DOUBLE AS cost FROM conversations" % lex.romaji_pattern(),
)
