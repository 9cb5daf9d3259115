"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate over text features that is true where a document is to be rejected.
`order_rules` measures each rule's run time and rejection share on a sample of the rows, and
`cascade` evaluates the rules in order of rejections per cost inside one CASE, whose later
branches are not evaluated once a rule has fired. A text is split into words once; features
that only later rules need are computed in their branches. The order never changes the verdict.

Null text counts as empty. Empty tables give empty results. Repeated rows are judged alike.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words

SYMBOLS = "#*$%&|<>"


def feature_columns(text: Column, w: Column | None = None) -> dict[str, Column]:
    """Each feature as an expression on the text, and on its words w where they are at hand."""
    text = F.coalesce(text, F.lit(""))
    of_words = (lambda body: let(words(text), body)) if w is None else (lambda body: body(w))

    def dropped(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words(text) if w is None else w).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": dropped(SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": of_words(repeat_words).cast("long"),
        "n_upper": dropped("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "n_lower": dropped("abcdefghijklmnopqrstuvwxyz").cast("long"),
        "n_marks": dropped("!?").cast("long"),
    }


def repeat_words(w: Column) -> Column:
    """Words of w that lie in a 3-word window found twice or more in w.

    Windows are compared by the 64-bit hash of their three words. Positions of repeated windows
    are found by sorting (hash, position); each such window then covers the words up to the
    next one, at most three.
    """
    hashes = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        F.lit(1),
        F.greatest(F.size(w) - 2, F.lit(0)),
    )

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.transform(
                s,
                lambda e, i: F.when(
                    F.coalesce(F.get(s, i - 1)["g"] == e["g"], F.lit(False))
                    | F.coalesce(F.get(s, i + 1)["g"] == e["g"], F.lit(False)),
                    e["i"],
                ),
            )
            return F.sort_array(F.filter(twin, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(tagged, places), total)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


@dataclass(frozen=True)
class Rule:
    """rejects: from a feature's name to its column, to the predicate that rejects."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Production rules. Thresholds apply to counts, so that they are exact in integers.
RULES = (
    Rule("symbols", lambda f: 10 * f("n_symbols") > 3 * f("n_words")),
    Rule("duplicate_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("capitals", lambda f: f("n_upper") > f("n_lower")),
    Rule("shouting", lambda f: 10 * f("n_marks") > 5 * f("n_words")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 25 * f("n_words"))),
)
#: The base conditions, in the same form.
BASE = (
    Rule("too_short", lambda f: f("n_words") < 50),
    Rule("repetition", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
)


def order_rules(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 1_000) -> list[Rule]:
    """rules by falling rejections per second, as measured on about sample_rows rows drawn from all of docs; the sample stays in the cluster."""
    n = docs.count()
    if not n:
        return list(rules)
    drawn = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, sample_rows / n), 17)
    sample = stored(drawn.coalesce(8), "sample").coalesce(1)
    worth = {}
    for rule in rules:
        seconds = []
        for _ in range(2):  # the first run also compiles
            start = time.perf_counter()
            hits = sample.agg(F.count_if(verdict(F.col("text"), [rule]).isNotNull())).first()[0]
            seconds.append(time.perf_counter() - start)
        worth[rule.name] = (hits + 0.5) / min(seconds)
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules, feature: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, in the given order; null if none does."""
    out = None
    for rule in rules:
        hit = rule.rejects(feature)
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def verdict(text: Column, rules) -> Column:
    """cascade() on a text: its words are split once, every other feature is computed where a branch needs it."""

    def body(w: Column) -> Column:
        exprs = feature_columns(text, w)
        return cascade(rules, lambda k: exprs[k])

    return let(words(text), body)


def judge(docs: DataFrame, rules=None, text_col: str = "text", out_col: str = "rejected_by") -> DataFrame:
    """docs with the name of the rule that rejects each row, or null. An existing out_col is replaced."""
    rules = order_rules(docs, (*BASE, *RULES), text_col) if rules is None else rules
    return docs.withColumn(out_col, verdict(F.col(text_col), rules))


#: Features that scored() returns of every row.
TOLD = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, names=None, text_col: str = "text") -> DataFrame:
    """doc_id, the named features of its text (all, if none are named), computed from its words split once, and the text."""

    def body(w: Column) -> Column:
        exprs = feature_columns(F.col(text_col), w)
        return F.struct(*(exprs[k].alias(k) for k in names or exprs))

    return docs.select("doc_id", F.col(text_col).alias("text"), let(words(F.col(text_col)), body).alias("f")).select("doc_id", "text", "f.*")


def scored(docs: DataFrame) -> DataFrame:
    """The told features, base_failed, the rule that rejects, and the verdict, for every row. Other features are computed only where the cascade comes to a rule that needs them."""
    rules = order_rules(docs)
    lazy = feature_columns(F.col("text"))
    base = BASE[0].rejects(F.col) | BASE[1].rejects(F.col)
    return (
        features(docs, TOLD)
        .withColumn("base_failed", base)
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules, lambda k: F.col(k) if k in TOLD else lazy[k])))
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("text")
    )


#: scored() in the oracle's SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT *, row_number() OVER () AS rid,
         [w[i] || ' ' || w[i+1] || ' ' || w[i+2] FOR i IN range(1, greatest(len(w) - 1, 1))] AS grams
  FROM d
), e AS (SELECT rid, unnest(grams) AS gram, unnest(range(len(grams))) AS pos FROM g),
r AS (SELECT rid, pos FROM e QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(least(3, coalesce(nxt - pos, 3)))::BIGINT AS n FROM
      (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) AS nxt FROM r) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(lines)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(text) - length(regexp_replace(text, '[a-z]', '', 'g')))::BIGINT AS n_lower,
         (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_marks
  FROM g LEFT JOIN c USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
         OR n_upper > n_lower OR 10 * n_marks > 5 * n_words
         OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
