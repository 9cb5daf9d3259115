"""A line's best cover by words: dynamic programs over unit positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kana import let, syllable_variants

FILLER = 1e6
DEFAULTS = {"DUPLICATE": True, "SAME_PHRASE_BREAK_REWARD": 1.0, "MID_PHRASE_BREAK_PENALTY": 0.0, "WORD_NUMBER_PENALTY": 1.0, "VARIATION_COST": 0.0}


def segments(lines: DataFrame, most: int) -> DataFrame:
    """(line, i, t, syllables) of every run of lines(line, units) that has a way of at most `most` units.

    Longer runs, which no word of at most `most` units can match, are left out; units that may be
    silent do not count.
    """
    least = F.transform("units", lambda u: F.array_min(F.transform(syllable_variants(u), lambda v: F.size(v["units"]))))
    before = F.aggregate(least, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + k)))
    ends = lines.select("line", "units", before.alias("before")).select("line", "units", "before", F.explode(F.when(F.size("units") > 0, F.sequence(F.lit(1), F.size("units")))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.get("before", F.col("t")) - F.get("before", i) <= most)
    return ends.select("line", "units", "t", F.explode(starts).alias("i")).select("line", "i", "t", F.slice("units", F.col("i") + 1, F.col("t") - F.col("i")).alias("syllables"))


def phrase_breaks(phrase: Column) -> Column:
    """0 and every position whose phrase differs from the one before."""
    return let(phrase, lambda ph: F.filter(F.transform(ph, lambda p, i: F.when((i == 0) | (p != F.get(ph, i - 1)), i)), lambda x: x.isNotNull()))


def cover(n: Column, breaks: Column, costs: Column, longest: Column | int, parameters: dict | None = None) -> Column:
    """The best cover of n units when words may repeat, as array<struct<i, t, filler, score>>, in order.

    costs: map from i * 65536 + t to the best word's sim, whose longest run has `longest` units. Native: a fold over end positions that
    keeps the best (score, choice) of every prefix; of equal scores the earliest start and the
    filler before the word win.
    """
    p = DEFAULTS | (parameters or {})
    each = F.lit(float(p["WORD_NUMBER_PENALTY"]))

    def step(acc, t):
        def options(i):
            base = F.get(acc, i)["score"]
            sim = F.try_element_at(costs, i * 65536 + t)
            at = F.when(F.array_contains(breaks, t), F.lit(-float(p["SAME_PHRASE_BREAK_REWARD"]))).when(t != n, F.lit(float(p["MID_PHRASE_BREAK_PENALTY"]))).otherwise(F.lit(0.0))
            filler = F.when(t - i == 1, F.struct((base + FILLER + each).alias("score"), (2 * i).alias("choice")))
            word = F.when(sim.isNotNull(), F.struct((base + (sim + at) + each).alias("score"), (2 * i + 1).alias("choice")))
            return F.array(filler, word)

        best = F.array_min(F.filter(F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), t - longest), t - 1), options)), lambda x: x.isNotNull()))
        return F.concat(acc, F.array(best))

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("choice")))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def back(table):
        begin = F.struct(n.alias("at"), F.array().cast("array<struct<i:int,t:int,filler:boolean,score:double>>").alias("words"))

        def walk(state, _):
            choice = F.get(table, state["at"])["choice"]
            i = F.shiftright(choice, 1)
            word = F.struct(i.alias("i"), state["at"].alias("t"), (choice % 2 == 0).alias("filler"), (F.get(table, state["at"])["score"] - F.get(table, i)["score"] - each).alias("score"))
            return F.when(state["at"] > 0, F.struct(i.alias("at"), F.concat(F.array(word), state["words"]).alias("words"))).otherwise(state)

        return F.aggregate(steps, begin, walk)["words"]

    table = F.aggregate(steps, start, step)
    return F.get(F.transform(F.array(table), back), F.lit(0))


def best_path(n: int, breaks: set[int], ranked: dict[tuple[int, int], list[tuple[float, str]]], used: set[str], parameters: dict, s: int = 0, t: int | None = None) -> tuple[float, list[dict]]:
    """The cover of units s to t whose words are neither used nor repeated on the way, prefix by prefix.

    Each end takes the best prefix's first word that is free; that is the method, not an optimum
    over all covers. Of equal scores the earliest start and the filler win.
    """
    t = n if t is None else t
    each = parameters["WORD_NUMBER_PENALTY"]
    best: dict[int, tuple[float, list[dict]]] = {s: (0.0, [])}
    starts: dict[int, list[int]] = {}
    for i, e in ranked:
        starts.setdefault(e, []).append(i)
    for e in range(s + 1, t + 1):
        choice = None
        for i in sorted({*starts.get(e, ()), e - 1}):
            if i < s:
                continue
            base, path = best[i]
            if e - i == 1 and (choice is None or base + FILLER + each < choice[0]):
                choice = (base + FILLER + each, path, {"i": i, "t": e, "id": None, "sim": FILLER, "score": FILLER})
            here = {w["id"] for w in path}
            free = next((x for x in ranked.get((i, e), ()) if parameters["DUPLICATE"] or (x[1] not in used and x[1] not in here)), None)
            if free is not None:
                score = free[0] - parameters["SAME_PHRASE_BREAK_REWARD"] if e in breaks else free[0] + (parameters["MID_PHRASE_BREAK_PENALTY"] if e != n else 0.0)
                if choice is None or base + score + each < choice[0]:
                    choice = (base + score + each, path, {"i": i, "t": e, "id": free[1], "sim": free[0], "score": score})
        best[e] = (choice[0], [*choice[1], choice[2]])
    return best[t]


GENERATED = "song long, line long, word int, i int, t int, id string, sim double, score double, filler boolean, locked boolean"


def generate(lines: DataFrame, candidates: DataFrame, parameters: dict | None = None, locks: DataFrame | None = None) -> DataFrame:
    """Words for every line of every song, lines in order; with DUPLICATE off no word comes twice in a song.

    lines(song, line, n, breaks); candidates(song, line, i, t, rank, sim, id): as many ranks as
    the song can use up; locks(song, line, i, t, id, sim), optional: pinned words. A song is one
    group, since each line depends on the words before it; songs are independent.
    """
    p = DEFAULTS | (parameters or {})
    spans = candidates.groupBy("song", "line", "i", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sim", "id"))), lambda x: F.struct(x["sim"].alias("sim"), x["id"].alias("id"))).alias("c"))
    per_line = spans.groupBy("song", "line").agg(F.collect_list(F.struct("i", "t", "c")).alias("spans"))
    rows = lines.select("song", "line", "n", "breaks").join(per_line, ["song", "line"], "left")
    if locks is not None:
        rows = rows.join(locks.groupBy("song", "line").agg(F.array_sort(F.collect_list(F.struct("i", "t", "id", "sim"))).alias("locks")), ["song", "line"], "left")
    else:
        rows = rows.withColumn("locks", F.lit(None).cast("array<struct<i:int,t:int,id:string,sim:double>>"))

    def song(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for r in pdf.sort_values("line", kind="stable").itertuples():
            spans_ = r.spans if r.spans is not None and not isinstance(r.spans, float) else []
            ranked = {(x["i"], x["t"]): [(c["sim"], c["id"]) for c in x["c"]] for x in spans_}
            pinned = list(r.locks) if r.locks is not None and not isinstance(r.locks, float) else []
            breaks, busy = set(int(b) for b in r.breaks), used | {x["id"] for x in pinned if x["id"] is not None}
            words, at, n = [], 0, int(r.n)
            for lock in [*pinned, None]:
                end = n if lock is None else lock["i"]
                if at < end:
                    _, path = best_path(n, breaks, ranked, busy, p, at, end)
                    words += [(w, False) for w in path]
                    busy |= {w["id"] for w in path if w["id"] is not None}
                if lock is not None:
                    words.append((lock | {"score": lock["sim"]} if isinstance(lock, dict) else {"i": lock["i"], "t": lock["t"], "id": lock["id"], "sim": lock["sim"], "score": lock["sim"]}, True))
                    at = max(at, lock["t"])
            used |= {w["id"] for w, _ in words if w["id"] is not None}
            out += [(r.song, r.line, k, w["i"], w["t"], w["id"], w["sim"], w["score"], w["id"] is None, fixed) for k, (w, fixed) in enumerate(words)]
        return pd.DataFrame(out, columns=["song", "line", "word", "i", "t", "id", "sim", "score", "filler", "locked"])

    return rows.groupBy("song").applyInPandas(song, GENERATED)
