"""URL verdicts: fixed host and path rules, then association rules mined from labelled URLs.

A URL becomes a basket of tokens. Spark's FP-growth finds frequent baskets among the labelled
URLs, in which tokens that always come together count as one; those with enough support and
confidence for `block` become rules, pruned of every rule that a shorter one with no less
confidence covers. Rules are matched by inverted index: each rule is filed under its rarest
token, a URL's tokens are joined to that index, and a rule fires when all its tokens are there.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host and path as in `example.net/en/`): the longest that fits wins.
FIXED = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS, MAX_TOKENS = 0.002, 0.8, 8, 3
BLOCKED = "block!"
#: A basket is hot if it holds more than 1 in HOT of the rows that no fixed rule decides.
HOT = 512


def host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def fixed_rule(host: Column, path: Column, rules=FIXED) -> Column:
    """The longest fixed rule that fits, as struct<rule, verdict>; null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels, the last two together, path segments with numbers as #, query keys, fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
            F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
            F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"[0-9]+", "#"))),
            F.transform(keys, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS, max_tokens: int = MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Rules and token classes from labelled(tokens, blocked).

    Rules: (rule_id, tokens, key, size, support, confidence), their tokens are heads of classes.
    Classes: (token, head); a class is the tokens of exactly the same labelled rows, so that a
    rule on its head holds for each of them. Before FP-growth runs, tokens with too few blocked
    rows go, since no rule can hold them, and classes become their heads: neither changes a
    rule, and long sets of tokens that always come together do not unfold into all their subsets.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "rule_id long, tokens array<string>, key string, size int, support double, confidence double"), spark.createDataFrame([], "token string, head string")
    given = stored(labelled.select(F.monotonically_increasing_id().alias("row"), F.sort_array("tokens").alias("tokens"), (F.col("blocked") == 1).alias("bad")), "labelled")
    n = given.count()
    if not n:
        return none
    need = ceil(max(min_support, min(1.0, min_rows / n)) * n)
    each = given.select("row", "bad", F.explode("tokens").alias("token"))
    extent = F.struct(F.count("*"), F.sum(F.xxhash64("row").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("x"), "row")))
    seen = each.groupBy("token").agg(F.count_if("bad").alias("hits"), extent.alias("extent")).where(F.col("hits") >= need)
    classes = stored(seen.withColumn("head", F.min("token").over(Window.partitionBy("extent"))).select("token", "head"), "classes")
    # the rows of a class's members are those of its head
    baskets = stored(each.join(classes.where("token = head"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items")), "baskets")
    rows = baskets.count()
    if rows < need:
        return none
    marked = baskets.select(F.when(F.col("bad"), F.array_append("items", BLOCKED)).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / rows, minConfidence=0.0).fit(marked)
    freq = stored(model.freqItemsets.where(F.size("items") <= max_tokens + 1).withColumn("items", F.sort_array("items")), "itemsets")
    both = freq.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("hits"))
    rules = both.join(freq, "items").select(F.col("items").alias("tokens"), (F.col("hits") / F.lit(float(n))).alias("support"), (F.col("hits") / F.col("freq")).alias("confidence"))
    rules = rules.where(F.col("confidence") >= min_confidence)
    # a rule goes if one token less gives no less confidence
    less = rules.where("size(tokens) > 1").select(F.col("tokens").alias("whole"), F.col("confidence").alias("c"), F.explode(F.transform("tokens", lambda t: F.array_remove(F.col("tokens"), t))).alias("tokens"))
    covered = less.join(rules.select("tokens", "confidence"), "tokens").where("confidence >= c").select(F.col("whole").alias("tokens")).distinct()
    kept = rules.join(covered, "tokens", "left_anti")
    alone = freq.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keyed = kept.select("tokens", "support", "confidence", F.explode("tokens").alias("token")).join(alone, "token").groupBy("tokens", "support", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return stored(keyed.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "key", F.size("tokens").alias("size"), "support", "confidence"), "rules"), classes


def judged(pages: DataFrame, labelled: DataFrame | None, id_col: str = "page_id", url_col: str = "url", fixed=FIXED, **limits) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined) of every row.

    rule: the fixed rule that decides, else null; mined: the surest mined rule that fires where
    no fixed one does. labelled(url, blocked 0/1) may be None: then nothing is mined. A null url
    or one without `://` has empty host and path and is allowed; repeated rows get equal
    verdicts; an empty table gives no rows; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host(url).alias("host"), path(url).alias("path")).withColumn("f", fixed_rule(F.col("host"), F.col("path"), fixed))
    if labelled is None:
        return rows.select("page_id", "url", "host", "path", F.col("f.rule").alias("rule"), F.coalesce("f.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    u = F.col("url").cast("string")
    rules, classes = mine(labelled.where("blocked IS NOT NULL AND url IS NOT NULL").select(tokens(host(u), path(u), u).alias("tokens"), "blocked"), **limits)
    # distinct token sets meet the index, not pages: repeated baskets are judged once; rows that a fixed rule decides take no part
    free = rows.where("f IS NULL").withColumn("basket", F.sort_array(tokens(F.col("host"), F.col("path"), F.col("url"))))
    own = stored(free.groupBy("basket").agg(F.count("*").alias("n")), "urls")
    heads = own.select("basket", F.explode("basket").alias("token")).join(classes, "token").groupBy("basket").agg(F.collect_set("head").alias("heads"))
    fired = (
        heads.select("basket", "heads", F.explode("heads").alias("key"))
        .join(rules.select("key", "tokens", "confidence"), "key")
        .where(F.size(F.array_except("tokens", "heads")) == 0)
        .groupBy("basket")
        .agg(F.max_by("tokens", F.struct("confidence", "tokens")).alias("mined"))
    )
    fired = stored(own.join(fired, "basket"), "fired")
    # a basket of more than 1 in HOT rows, of which there are fewer than HOT, is told by broadcast; the others by a join
    total = own.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > total
    hot = own.where(often).select("basket").join(fired.select("basket", "mined"), "basket", "left")
    known = free.join(F.broadcast(hot), "basket").drop("basket")
    rare = free.join(F.broadcast(own.where(often).select("basket")), "basket", "left_anti").join(fired.where(~often).select("basket", "mined"), "basket", "left").drop("basket")
    out = rows.where("f IS NOT NULL").withColumn("mined", F.lit(None).cast("array<string>")).unionByName(known).unionByName(rare)
    verdict = F.coalesce(F.col("f.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "url", "host", "path", F.col("f.rule").alias("rule"), verdict.alias("verdict"), "mined")
