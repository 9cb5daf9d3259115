"""Word lists: tidy CSV (header, no quoting) and plain lists, as DataFrames, and the word table made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kana
from ..functions.english import first_wide_letter, format_kana
from ..plans.store import stored
from ..plans.where import compiled
from .dictionary import with_entries


def _offsets(spark: SparkSession, sizes: list[tuple], kind: str) -> DataFrame:
    """(.., before): for (key .., n) in order, the sum of n of all keys before. One row for each partition or file split."""
    out, total = [], 0
    for *key, n in sizes:
        out.append((*key, total))
        total += n
    return spark.createDataFrame(out, kind)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in their present order: sizes of earlier partitions (one number each, broadcast) plus the place in the own.

    The marked rows are written once, since a sort that runs twice may cut its ranges elsewhere.
    """
    marked = stored(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["n"]) for r in marked.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before = _offsets(df.sparkSession, sizes, "_part long, _before long")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + place).alias(name))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, seq, value) of a text file or folder: line counts from 0 in each file, seq over all files in order of their paths, however Spark deals them out."""
    meta = F.col("_metadata")
    text = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_at"))
    sizes = sorted((r["file"], r["_block"], r["first"], r["n"]) for r in text.groupBy("file", "_block").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect())
    rows, total, line = [], 0, 0
    for k, (file, block, first, n) in enumerate(sizes):
        line = line if k and sizes[k - 1][0] == file else 0
        rows.append((file, block, first, total, line))
        total, line = total + n, line + n
    before = spark.createDataFrame(rows, "file string, _block long, _first long, _total long, _line long")
    place = F.col("_at") - F.col("_first")
    return text.join(F.broadcast(before), ["file", "_block"]).select("file", (F.col("_line") + place).alias("line"), (F.col("_total") + place).alias("seq"), F.regexp_replace("value", "\r$", "").alias("value"))


def cells(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "[ \t]*,[ \t]*", ","), ",")


def tidy(lines: DataFrame, header: str, where: str = "", line_col: str = "value") -> DataFrame:
    """Data lines as columns named by the header: blanks around commas go, short rows give nulls, further cells are ignored, blank lines are skipped."""
    names = [c.strip(" \t") if i else c for i, c in enumerate(header.split(","))]
    c = F.col("_cells")
    out = lines.where(F.col(line_col) != "").withColumn("_cells", cells(F.col(line_col)))
    keep = [x for x in lines.columns if x != line_col]
    out = out.select(*keep, *(F.get(c, F.lit(i)).alias(n) for i, n in enumerate(names)))
    return out.filter(compiled(where, names))


def read_tidy(spark: SparkSession, path: str, where: str = "") -> DataFrame:
    """A tidy CSV file, or a folder of them, with the line number over all files as seq.

    The first line of each file is its header and is dropped; a later line that equals it is
    data. The columns are those of the first file by path.
    """
    lines = read_lines(spark, path)
    first = lines.where("line = 0").orderBy("file").select("value").first()
    if first is None:
        return spark.createDataFrame([], "seq long")
    return tidy(lines.where("line > 0").select("seq", "value"), first[0].lstrip("\ufeff"), where)


def plain(lines: DataFrame, order_col: str, line_col: str = "value") -> DataFrame:
    """(id, seq, original, surface, pronunciation) of a plain list: `headword[,reading ...] # comment`.

    id counts the lines that are left, from 0, in order of order_col; a headword alone is its
    own reading; each further non-empty cell is a reading of its own, on a row with the same
    headword. Blanks around the headword and before a reading go.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(line_col), "(?s)#.*$", ""), "\u200b", "")
    kept = lines.select(order_col, F.split(text, ",").alias("c")).where(F.get("c", F.lit(0)) != "")
    numbered = with_row_index(kept.sort(order_col), "id")
    readings = F.when(F.size("c") == 1, F.slice("c", 1, 1)).otherwise(F.filter(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda x: x != ""))
    head = F.regexp_replace(F.get("c", F.lit(0)), "^[ \t]+|[ \t]+$", "")
    out = numbered.select(F.col("id").cast("string").alias("id"), head.alias("original"), F.posexplode(readings).alias("seq", "said"))
    return out.select("id", "seq", "original", F.col("original").alias("surface"), F.regexp_replace("said", "^[ \t]+", "").alias("pronunciation"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return plain(read_lines(spark, path).select("seq", "value"), "seq")


def reading(columns: list[str]) -> Column:
    """The pronunciation cell unless it is missing, empty, NA or na; else the surface."""
    if "pronunciation" not in columns:
        return F.col("surface")
    p = F.col("pronunciation")
    return F.when(p.isNull() | p.isin("", "NA", "na"), F.col("surface")).otherwise(p)


def _said_by(rows: DataFrame, english: DataFrame) -> DataFrame:
    """rows whose kana, a reading yet to be made uniform, is told with a dictionary table."""
    latin = F.col("kana").rlike("[a-zA-Z']")
    runs = F.transform(F.regexp_extract_all("kana", F.lit("[a-zA-Z']+"), 0), lambda r: F.upper(first_wide_letter(r)))
    own = with_entries(rows.where(latin).select("kana").distinct(), ["kana"], runs, english, "_english")
    told = own.select(F.col("kana").alias("_from"), format_kana(F.col("kana"), F.col("_english")).alias("_said"))
    joined = rows.where(latin).join(told, F.col("kana") == F.col("_from")).withColumn("kana", F.col("_said")).drop("_from", "_said")
    return rows.where(~latin).withColumn("kana", format_kana(F.col("kana"))).unionByName(joined)


def words(rows: DataFrame, max_units: int | None = None, get_yomi: Callable[[Column], Column] | None = None, order: tuple[str, ...] = (), english: DataFrame | None = None) -> DataFrame:
    """The word table: one row for each way to say each word of rows(id, surface[, original, pronunciation]).

    Readings with kanji go through get_yomi, where one is given; empty readings drop out.
    n_units is the number of units, by which words are matched; ordinal is the way's number.
    max_units keeps long readings from unfolding into more ways than any line can use. english
    (word, said) is a dictionary table of any length; readings with Latin runs are made distinct before they meet it.
    """
    said = reading(rows.columns)
    if get_yomi is not None:
        said = F.when(said.rlike("[一-龠]"), get_yomi(said)).otherwise(said)
    original = F.col("original") if "original" in rows.columns else F.col("surface")
    base = rows.select(*order, F.col("id").cast("string").alias("id"), "surface", original.alias("original"), (format_kana(said) if english is None else said).alias("kana"))
    if english is not None:
        base = _said_by(base, english)
    base = base.where("kana <> ''")
    ways = base.select("*", F.posexplode(kana.ways(F.col("kana"), max_units)).alias("ordinal", "v"))
    return ways.select(*order, "id", "surface", "original", "kana", "ordinal", F.col("v.units").alias("units"), F.col("v.vcost").alias("vcost"), F.size("v.units").alias("n_units"))


def id_order(id_: Column, first_seen: Column) -> list[Column]:
    """Sort keys of ids: integer-like ones first, by number, then others as first seen."""
    number = F.when(id_.rlike(r"^(0|[1-9][0-9]{0,9})$") & (id_.try_cast("long") < 4294967295), id_.try_cast("long"))
    return [number.isNull(), F.coalesce(number, F.lit(0)), first_seen]


def in_id_order(df: DataFrame, id_col: str, seen_col: str) -> Window:
    return Window.orderBy(*id_order(F.col(id_col), F.col(seen_col)))
