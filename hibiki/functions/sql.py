"""The functions under SQL names, as temporary functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .english import ENGLISH, to_kana
from .ruby import PARSED, parse


def register_all(spark: SparkSession) -> list[str]:
    """Registers romaji_kana(text) and ruby_parsed(text); the other functions are Column expressions and need none."""

    @F.pandas_udf("string")
    def romaji_kana(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None else to_kana(x, ENGLISH))

    @F.pandas_udf(PARSED)
    def ruby_parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) if v is not None else {"plain": None, "annotations": None} for v in values], columns=["plain", "annotations"])

    spark.udf.register("romaji_kana", romaji_kana)
    spark.udf.register("ruby_parsed", ruby_parsed)
    return ["romaji_kana", "ruby_parsed"]
