"""The training-data pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns that they got.
Rows with nulls, blank texts, repeated rows and empty tables pass through as each operator
defines; columns beyond doc_id and text, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hibiki.llm import decontam, packing, rules, simhash, substring
from hibiki.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a base condition or a quality rule rejects; null text counts as empty and is rejected."""
    ordered = rules.order_rules(docs, (*rules.BASE, *rules.RULES))
    return docs.where(rules.verdict(F.col("text"), ordered).isNull())


def quoted(name: str) -> str:
    """A column's name as expressions read it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it apart from every column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least (doc_id, text hash) of each near-duplicate group, and one of repeated rows.

    Documents are near duplicates if their sets of five-word shingles have a similarity of 0.8
    or more, over chains. Null and blank texts are one group; no rows give none.
    """
    best = free_name(docs, "best")
    keys = simhash.representatives(docs).select(F.struct("doc_id", "seal", "again").alias(best))
    seal = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(keys[best]["doc_id"]) & (seal == keys[best]["seal"]))
    columns = list(map(quoted, docs.columns))
    once = kept.where(~F.col(best)["again"]).select(*columns)
    # of rows with equal id and text, which differ in other columns at most, the first by the hash of all columns' JSON stays
    row = F.struct(*columns)
    first = kept.where(F.col(best)["again"]).groupBy(best).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("x"))
    return once.unionByName(first.select("x.*"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes long repeated passages out of every text; the other words stay, and texts without any as they are."""
    others = [c for c in docs.columns if c != "text"]
    out = substring.remove_repeats(docs, untouched=True, carry=others)
    text = F.col("kept")
    return out.select(*(text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("carry").getField(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item, copied or paraphrased.

    A row is told by its id and the hash of its text, so that rows of the same id, null included,
    with other texts stay; repeated rows go or stay together; null and empty texts stay.
    """
    seal = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.struct("doc_id", "seal").alias("hit")).distinct()
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["hit.doc_id"]) & (seal == hits["hit.seal"]), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, measured in token ids, and their places in training sequences.

    Null and empty texts have length 1, their end id; rows with repeated or null ids are packed
    one by one; no rows give no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express SimHash, the retrieval and the packing: tests/llm holds stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
