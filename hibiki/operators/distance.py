"""Unit distances, candidate words by equal unit count, their order and the best few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kana
from ..functions.lexicon import consonant_matrix, units, vowel_matrix
from ..sources.wordlist import id_order

REWARDS = {"SAME_KANA_REWARD": 1.0, "SAME_VOWEL_REWARD": 1.0, "SAME_CONSONANT_REWARD": 1.0, "SAME_HATSUON_REWARD": 1.0, "SAME_SOKUON_REWARD": 1.0}


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, v) for k, (c, v) in units().items()], "kana string, c string, v string")


def matrix(spark: SparkSession, values: dict[tuple[str, str], float]) -> DataFrame:
    return spark.createDataFrame([(a, b, float(d)) for (a, b), d in values.items()], "x string, y string, d double")


def scaled(m: DataFrame, factor: float) -> DataFrame:
    """Every cell times factor."""
    return m.withColumn("d", F.col("d") * factor)


def unit_matrix(spark: SparkSession, vowels: DataFrame | None = None, consonants: DataFrame | None = None, lex: DataFrame | None = None) -> DataFrame:
    """(u1, u2, dist) of all pairs of units, (consonant + vowel distance) / 2: 377 x 377 rows, whatever the data."""
    lex = lexicon(spark) if lex is None else lex
    vowels = matrix(spark, vowel_matrix()) if vowels is None else vowels
    consonants = matrix(spark, consonant_matrix()) if consonants is None else consonants
    a, b = lex.select(F.col("kana").alias("u1"), F.col("c").alias("c1"), F.col("v").alias("v1")), lex.select(F.col("kana").alias("u2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    c = consonants.select(F.col("x").alias("c1"), F.col("y").alias("c2"), F.col("d").alias("dc"))
    v = vowels.select(F.col("x").alias("v1"), F.col("y").alias("v2"), F.col("d").alias("dv"))
    # a fixed table: each unit meets the row of its own consonant, then of its own vowel
    return a.join(c, "c1").join(b, "c2").join(v, ["v1", "v2"]).select("u1", "u2", ((F.col("dc") + F.col("dv")) / 2).alias("dist"))


def same_kana(a: Column, b: Column) -> Column:
    return a == b


def same_bar(a: Column, b: Column) -> Column:
    return a.endswith("ー") & b.endswith("ー")


def same_sokuon(a: Column, b: Column) -> Column:
    return a.endswith("ッ") & b.endswith("ッ")


def same_hatsuon(a: Column, b: Column) -> Column:
    return a.endswith("ン") & b.endswith("ン")


def same_vowel(a: Column, b: Column) -> Column:
    return kana.kana_vowel(a) == kana.kana_vowel(b)


def same_consonant(a: Column, b: Column) -> Column:
    return kana.kana_consonant(a) == kana.kana_consonant(b)


def rewarded(dist: DataFrame, parameters: dict | None = None) -> DataFrame:
    """dist with each reward multiplied in where its likeness holds; a bar reward is accepted and has no effect."""
    p = REWARDS | {k: v for k, v in (parameters or {}).items() if k in REWARDS}
    a, b = F.col("u1"), F.col("u2")
    d = F.col("dist")
    for likeness, name in ((a == b, "SAME_KANA_REWARD"), (same_vowel(a, b), "SAME_VOWEL_REWARD"), (same_consonant(a, b), "SAME_CONSONANT_REWARD"), (same_hatsuon(a, b), "SAME_HATSUON_REWARD"), (same_sokuon(a, b), "SAME_SOKUON_REWARD")):
        d = d * F.when(likeness, F.lit(float(p[name]))).otherwise(F.lit(1.0))
    return dist.withColumn("dist", d)


def normalized_weights(w: Column, n: Column) -> Column:
    """w scaled to a mean of 1; null where it is null, not n long, empty, negative, not finite or of sum 0."""
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    fine = F.forall(w, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf"))))
    return F.when((F.size(w) == n) & (n > 0) & fine & (total > 0), F.transform(w, lambda x: x * n / total))


def expanded_weights(src: Column, w: Column) -> Column:
    """Each unit's weight, by its syllable; null where a syllable has none."""
    return F.when(F.forall(src, lambda k: (k >= 0) & (k < F.size(w))), F.transform(src, lambda k: F.get(w, k)))


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)).cast("int") - 1


def find_min(value: Column, at: Column) -> Column:
    """Aggregate struct(value, at) of the least value that is not infinite, the least at among equals; null if there is none."""
    return F.min(F.when(value.isNotNull() & ~F.isnan(value) & (value < F.lit(float("inf"))), F.struct(value.alias("value"), at.alias("at"))))


def org_round(x: Column, b: Column | float) -> Column:
    """x rounded to a multiple of 1 / b, halves to even."""
    b = F.lit(b) if isinstance(b, (int, float)) else b
    return F.rint(x * b) / b


def argsort(a: Column) -> Column:
    """Stable: indexes by value."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def product(lists: Column) -> Column:
    """All choices of one string from each list, the last list turning fastest; of no lists none."""
    start = F.array(F.array().cast("array<string>"))
    out = F.aggregate(lists, start, lambda acc, xs: F.flatten(F.transform(acc, lambda a: F.transform(xs, lambda x: F.concat(a, F.array(x))))))
    return F.when(F.size(lists) == 0, F.array().cast("array<array<string>>")).otherwise(out)


def pair_distances(pairs: DataFrame, dist: DataFrame, keys: list[str], weights: bool = False) -> DataFrame:
    """keys, n and d for pairs(keys, a, b[, w]): the sum of unit distances; pairs with an unknown unit or unequal length are left out (infinitely far)."""
    w = [F.col("w")] if weights else []
    rows = pairs.where((F.size("a") == F.size("b")) & (F.size("a") > 0)).select(*keys, F.size("a").alias("n"), F.explode(F.arrays_zip("a", "b", *w)).alias("z"))
    rows = rows.select(*keys, "n", F.col("z.a").alias("u1"), F.col("z.b").alias("u2"), *([F.col("z.w").alias("w")] if weights else []))
    value = F.col("dist") * F.col("w") if weights else F.col("dist")
    # the distance table has a fixed 142,129 rows
    return rows.join(F.broadcast(dist), ["u1", "u2"]).groupBy(*keys, "n").agg(F.sum(value).alias("d"), F.count("*").alias("k")).where("k = n").select(*keys, "d")


def unit_codes(units_: Column, names: list[str]) -> Column:
    """A list of units as one string, a character each; null where a unit is not in names."""
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(chr(0x4E00 + i)) for i in range(len(names)))))
    codes = F.transform(units_, lambda u: F.try_element_at(table, u))
    return F.when(F.forall(codes, lambda c: c.isNotNull()), F.array_join(codes, ""))


def code_distances(dist: DataFrame):
    """(names, score): score(a, b) sums the distances of two coded lists of equal length, left to right, in Arrow batches.

    The table has one row for each pair of units, so a few hundred squared, whatever the data.
    """
    rows = dist.collect()
    names = sorted({r.u1 for r in rows})
    place = {n: i for i, n in enumerate(names)}
    grid = np.full((len(names), len(names)), np.inf)
    for r in rows:
        grid[place[r.u1], place[r.u2]] = r.dist
    shared = dist.sparkSession.sparkContext.broadcast(grid)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        place = lambda s: np.frombuffer("".join(s).encode("utf-32-le"), "<u4").astype(np.int64) - 0x4E00
        sizes = a.str.len().to_numpy()
        return pd.Series(np.add.reduceat(shared.value[place(a), place(b)], np.cumsum(sizes) - sizes))

    return names, score


def nearest(targets: DataFrame, words: DataFrame, dist: DataFrame, variation_cost: float = 0.0, max_units: int | None = None) -> DataFrame:
    """(target, id, sim, n_units, seq, seen): the best way to say each word for each target.

    targets(target string, syllables array): its ways meet the words' ways of equal unit count.
    words(id, n_units, seq, units, vcost): seq orders the ways as they were read. Of equal best
    ways the one read last counts. Only distinct unit lists are compared, so that words that
    sound alike and ways that several targets share are scored once. max_units: the most units
    of any word, where known; targets' longer ways are then not made.
    """
    names, score = code_distances(dist)
    ways = targets.select("target", F.explode(kana.variations(F.col("syllables"), max_units)).alias("v")).select("target", unit_codes(F.col("v.units"), names).alias("a"), F.col("v.vcost").alias("va")).where("a IS NOT NULL")
    coded = words.select("id", "n_units", "seq", "vcost", unit_codes(F.col("units"), names).alias("b")).where("b IS NOT NULL")
    asked, said = ways.select("a", F.length("a").alias("n_units")).distinct(), coded.select("b", "n_units").distinct()
    scored = asked.join(said, "n_units").select("a", "b", score("a", "b").alias("d"))
    best = ways.join(scored, "a").join(coded, "b")
    sim = F.col("d") + (F.col("va") + F.col("vcost")) * F.lit(float(variation_cost))
    per_way = best.groupBy("target", "id", "n_units", "seq").agg(F.min(sim).alias("sim"))
    return per_way.groupBy("target", "id").agg(F.min(F.struct("sim", (-F.col("n_units")).alias("n"), (-F.col("seq")).alias("s"))).alias("x"), F.min(F.struct("n_units", "seq")).alias("seen")).select("target", "id", "x.sim", (-F.col("x.n")).alias("n_units"), (-F.col("x.s")).alias("seq"), "seen")


def ranked(found: DataFrame) -> DataFrame:
    """nearest() with rank: by sim, then integer ids by number, then others as first seen."""
    w = Window.partitionBy("target").orderBy("sim", *id_order(F.col("id"), F.col("seen")))
    return found.withColumn("rank", F.row_number().over(w))


def top(found: DataFrame, k: int = 30) -> DataFrame:
    return ranked(found).where(F.col("rank") <= k)
