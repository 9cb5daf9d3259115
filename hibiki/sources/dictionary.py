"""Dictionaries as tables, so that their size is Spark's affair: joins on distinct words or characters, broadcast only where Spark has checked the size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.lexicon import ENGLISH, KANJI


def english(spark: SparkSession, values: dict[str, str] | None = None) -> DataFrame:
    """(word, said) of a dictionary at hand, by default the small one of our own."""
    return spark.createDataFrame(list((ENGLISH if values is None else values).items()), "word string, said string")


def kanji(spark: SparkSession, values: dict[str, list[str]] | None = None) -> DataFrame:
    """(kanji, readings) of a dictionary at hand, by default the small one of our own."""
    return spark.createDataFrame(list((KANJI if values is None else values).items()), "kanji string, readings array<string>")


def read_english(spark: SparkSession, path: str) -> DataFrame:
    """(word, said) of a JSON file with one object, word to kana."""
    return _read(spark, path, "map<string,string>").select(F.col("e.key").alias("word"), F.col("e.value").alias("said"))


def read_kanji(spark: SparkSession, path: str) -> DataFrame:
    """(kanji, readings) of a JSON file with one object, kanji to its readings."""
    return _read(spark, path, "map<string,array<string>>").select(F.col("e.key").alias("kanji"), F.col("e.value").alias("readings"))


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).select(F.explode(F.map_entries(F.from_json("value", kind))).alias("e"))


def looked_up(rows: DataFrame, word: str, table: DataFrame, out: str) -> DataFrame:
    """rows with out: the kana of each word in table(word, said), whatever its case, or else the word.

    Distinct words meet the dictionary, and what they find goes back to the rows, so that a
    frequent word is looked up once. Of several entries of a word the least counts.
    """
    entries = table.groupBy("word").agg(F.min("said").alias("_said"))
    words = rows.select(F.col(word).alias("_word")).where("_word IS NOT NULL").distinct()
    known = words.join(entries, F.upper("_word") == entries["word"]).select("_word", "_said")
    return rows.join(known, rows[word] == known["_word"], "left").select(*rows.columns, F.coalesce("_said", F.col(word)).alias(out))


def kanji_texts(rows: DataFrame, key: str, text: str, table: DataFrame, out: str) -> DataFrame:
    """(key, out): the first readings of each text's kanji in order; characters without one drop out. Null text gives null; keys must be distinct."""
    first = table.where(F.size("readings") > 0).groupBy("kanji").agg(F.min(F.get("readings", F.lit(0))).alias("said"))
    # texts carry themselves through the one shuffle: nothing is joined back, so no side of a join can be taken for a small one
    places = rows.select(F.col(key).alias("_key"), F.col(text).isNull().alias("_null"), F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit("(?s)."), 0)).alias("_i", "kanji"))
    # single characters: no more entries than there are characters
    told = places.join(F.broadcast(first.where(F.length("kanji") == 1)), "kanji", "left")
    said = F.collect_list(F.when(F.col("said").isNotNull(), F.struct("_i", "said")))
    whole = told.groupBy("_key").agg(F.first("_null").alias("_null"), F.array_join(F.transform(F.array_sort(said), lambda x: x["said"]), "").alias("_out"))
    return whole.select(F.col("_key").alias(key), F.when(~F.col("_null"), F.col("_out")).alias(out))


def with_entries(rows: DataFrame, keys: list[str], words: Column, table: DataFrame, out: str) -> DataFrame:
    """rows with out, a map of those entries of table(word, said) that a row's words name.

    words: an array column. keys tell the rows apart. A row brings its few entries along, however
    long the dictionary is; of several entries of a word the least counts; rows without any get an
    empty map.
    """
    kind = table.schema["said"].dataType
    entries = table.where("said IS NOT NULL").groupBy("word").agg(F.min("said").alias("said"))
    asked = rows.select(*keys, F.explode(F.array_distinct(words)).alias("word")).where("word IS NOT NULL")
    found = asked.join(entries, "word").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "said"))).alias("_own"))
    found = found.select(*(F.col(k).alias(f"_at_{k}") for k in keys), "_own")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(ArrayType(kind)))
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    return rows.join(found, same, "left").select(*rows.columns, F.coalesce("_own", none).alias(out))
