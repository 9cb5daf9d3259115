"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

The words of every document are exploded, aggregated by (document, word) and then by document
for totals and distinct words. The other flags meet them by outer joins on the document, and one
aggregation counts, for every part, the documents of each of the 32 sets of filters that they
fail. Everything that depends on an order of filters follows from these 32 numbers.

A document is told by its id and a 64-bit hash of its text and part. Repeated rows of one
document are exploded once and counted as often as they come.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Percent: distinct words below this share fail B, capitals above this share of all characters fail C.
DISTINCT_SHARE, CAPITAL_SHARE = 50, 3
SYMBOLS = "[#$%&*|]"
SETS = 1 << len(FILTERS)

DOCUMENT = ["doc", "seal"]


def capitals(text: Column) -> Column:
    """The number of A-Z in a text."""
    return F.length(F.regexp_replace(text, "[^A-Z]+", ""))


def word_totals(rows: DataFrame) -> DataFrame:
    """(doc, seal, n_words, n_distinct) of rows(doc, seal, text); texts without words have no row.

    Rows of one document become one before they are exploded. They then lie in its partition,
    so that neither aggregation over words moves a row.
    """
    once = rows.groupBy(*DOCUMENT).agg(F.first("text").alias("text"))
    words = once.select(*DOCUMENT, F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return words.groupBy(*DOCUMENT, "word").agg(F.count("*").alias("n")).groupBy(*DOCUMENT).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: part, copies (rows that are alike), fails (bit i: fails the i-th filter), good, toxic.

    docs(doc_id, text, lang), labels(doc_id, quality, toxic). Null text and lang count as empty.
    A document fails E if another with a smaller id has its text; a null id comes after all
    others, and is no smaller than another null. Labels of a repeated id count if any says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    unnamed = F.col("doc_id").isNull()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.xxhash64(text, part, unnamed).alias("seal"), text.alias("text"), part.alias("part"), unnamed.alias("unnamed"))
    told = rows.select(*DOCUMENT, "part", "unnamed", F.sha2("text", 256).alias("sha"), (100 * capitals(F.col("text")) > CAPITAL_SHARE * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    alike = told.groupBy(*DOCUMENT).agg(F.count("*").alias("copies"), *(F.first(x).alias(x) for x in ("part", "unnamed", "sha", "c", "d")))
    # one row for each different text, however many documents share it: its first document
    first = told.groupBy("sha").agg(F.min(F.struct("unnamed", "doc")).alias("x")).select("sha", "x.doc", "x.unnamed", F.lit(True).alias("leads"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"), F.lit(False).alias("unnamed"))
    out = alike.join(word_totals(rows), DOCUMENT, "left").join(first, ["doc", "sha", "unnamed"], "left").join(marks, ["doc", "unnamed"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < MIN_WORDS, 100 * distinct < DISTINCT_SHARE * n, F.col("c"), F.col("d"), F.col("leads").isNull()]
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return out.select("part", "copies", mask.alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def counted(flags: DataFrame) -> DataFrame:
    """For every part three arrays of 32: documents, good and toxic ones that fail exactly the filters of each set."""
    counts = [F.sum(F.when(F.col("fails") == m, F.col("copies") * w).otherwise(F.lit(0))).cast("long").alias(f"{name}{m}") for name, w in (("all", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic"))) for m in range(SETS)]
    table = flags.groupBy("part").agg(*counts)
    return table.select("part", *(F.array(*(f"{name}{m}" for m in range(SETS))).alias(name) for name in ("all", "good", "toxic")))


def steps() -> Column:
    """All orders of the filters, step by step: (filter_order, step, own bit, bits applied before)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            own = 1 << FILTERS.index(f)
            rows.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {k}, 'own', {own}, 'before', {before})")
            before |= own
    return F.expr(f"array({', '.join(rows)})")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    shapley sums the removed documents of a step's filter over all orders: one that fails k
    filters is removed by each of them in 120 / k orders. No documents give no rows.
    """
    each = counted(flagged(docs, labels)).select("*", F.explode(steps()).alias("s")).select("part", "all", "good", "toxic", "s.*")
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))
    own, before = F.col("own"), F.col("before")

    def total(name: str, holds, share=lambda m: F.lit(1)) -> Column:
        return F.aggregate(sets, F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), F.get(F.col(name), m) * share(m)).otherwise(F.lit(0).cast("long")))

    hit = lambda m: m.bitwiseAND(own) != 0
    removed = lambda m: hit(m) & (m.bitwiseAND(before) == 0)
    turns = 1
    for k in range(2, len(FILTERS) + 1):
        turns *= k
    return each.select(
        "part", "filter_order", "step",
        total("all", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: hit(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("all", own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", hit, lambda m: (F.lit(turns) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, x, part, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS lead FROM t),
f AS (SELECT w.doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 3 * length(x) AS c, regexp_matches(x, '[#$%&*|]') AS d, doc_id > lead AS e,
  coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM w LEFT JOIN labels USING (doc_id)),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS h FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.v, q.v, r.v, s.v, u.v] AS vs FROM l p, l q, l r, l s, l u WHERE p.v + q.v + r.v + s.v + u.v = 31 AND p.v | q.v | r.v | s.v | u.v = 31),
k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, vs FROM o),
z AS (SELECT filter_order, step, vs[step] AS own, list_sum(vs[:step])::INT - vs[step] AS before FROM k),
parts AS (SELECT DISTINCT part FROM m),
j AS (SELECT parts.part, z.*, coalesce(sum(n) FILTER ((m & (own | before)) = 0), 0) AS kept, coalesce(sum(n) FILTER ((m & own) <> 0 AND (m & before) = 0), 0) AS removed,
  coalesce(sum(n) FILTER ((m & own) <> 0 AND (m & before) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = own), 0) AS unique_fails,
  coalesce(sum(g) FILTER ((m & own) <> 0 AND (m & before) = 0), 0) AS good_lost, coalesce(sum(h) FILTER ((m & own) <> 0 AND (m & before) = 0), 0) AS toxic_lost
  FROM parts CROSS JOIN z JOIN m ON m.part = parts.part GROUP BY ALL),
s AS (SELECT part, own, sum(removed) AS shapley FROM j GROUP BY ALL)
SELECT j.part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM j JOIN s ON s.part = j.part AND s.own = j.own
"""
