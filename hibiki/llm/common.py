"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir

#: A word: a maximal run of characters other than space, tab and the four line breaks.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators as one string, for str.translate and split.
BLANKS = " \t\n\x0b\x0c\r"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hibiki-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body names it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; of null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def salted(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps; every step is one aggregation and one join on
    the node, so that a hub is pre-aggregated and its join partition can be split. Nodes come
    from edges only; self links and repeated links are harmless; no edges give no rows.
    """
    stored_at = []

    def keep(df):
        out = stored(df, name)
        stored_at.append(out)
        return out

    def star(e: DataFrame, large: bool) -> DataFrame:
        # e holds (u, v), v < u. Large: every larger neighbour of u moves to u's smallest; small: every smaller one.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = both.join(least, "u")
        if large:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def seal(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = seal(now)
    while before[0]:
        nxt = keep(star(star(now, True), False))
        after = seal(nxt)
        now = nxt
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def added(parts: DataFrame, blocks: int) -> DataFrame:
    """Sums float32 tables given in blocks, rows (block int, blob binary[, times double]), task by task: one row a block, each part counted `times` times."""
    import numpy as np
    import pyarrow as pa

    def add(batches):
        total = {}
        for b in batches:
            times = b.column(2).to_pylist() if b.num_columns > 2 else [1.0] * b.num_rows
            for k, blob, n in zip(b.column(0).to_pylist(), b.column(1), times):
                x = np.frombuffer(blob.as_buffer(), "<f4") * np.float64(n)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], ["block", "blob"])

    n = min(salted(parts.sparkSession), blocks)
    return parts.repartition(n, "block").mapInArrow(add, "block int, blob binary")


def summed(parts: DataFrame, blocks: int) -> dict:
    """What `added` sums, at the driver: block to numpy array.

    For tables of a fixed size: what reaches the driver is one table, however many tasks made one.
    """
    import numpy as np

    return {r.block: np.frombuffer(r.blob, "<f4") for r in added(parts, blocks).collect()}
