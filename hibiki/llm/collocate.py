"""Phrase collocation mining over bounded suffix automata.

Texts fall into pieces at punctuation; equal pieces of a language are counted together. Each
shard of pieces becomes a generalised suffix automaton of bounded depth. Its states are the sets
of substrings that end at the same places, its suffix links lead from a state to that of the
longest shorter ending. States and links are read off the sorted reversed windows of the shard:
the tree of suffix links of a text is the suffix tree of the text read backwards, so a run of
windows that share their first d words is a substring of d words, its weight the number of end
places, and where a longer substring has the same run it is the same state.

Counts are reduced over all shards. A phrase is never more frequent than a word or a word pair
in it, so words are counted first, then pairs of frequent words, then longer phrases over
frequent pairs. What is frequent reaches the shards as a filter of fixed size, which may let
rare words through and never holds a frequent one back. Suffix links, and their mirror images,
then lead from each frequent phrase to the shorter ones that it may subsume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted, stored

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2_000
#: Percent: a phrase goes if a longer one is this frequent beside it.
SUBSUMED = 80
#: Scores are in millionths of the mean share of both parts.
SCALE = 2_000_000
#: Words of one automaton; a task makes as many as its rows need.
SHARD_WORDS = 2_000_000
#: Bits of the filter of frequent phrases: 8 MB, whatever the data.
FILTER_BITS = 1 << 26
#: First ranks are found in so many groups of a language, then among them.
RANK_GROUPS = 256
BREAKS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in BREAKS else 32 if c == 9 else c for c in range(256))
PHRASE = "lang string, phrase string, n long"


def _folded(texts: pa.Array) -> pa.Array:
    """Lower-cased A-Z, each punctuation mark a line break, each tab a blank: byte by byte, so that places stay."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    raw = b"" if data is None else data.to_pybytes().translate(_FOLD)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw), None, 0, texts.offset)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            some = batch.slice(at, 2_000)
            langs = some.column(0)
            lines = pc.split_pattern(_folded(some.column(1)), "\n")
            owner, flat = pc.list_parent_indices(lines), pc.ascii_trim(lines.flatten(), " ")
            told = pc.not_equal(flat, "")
            owner, flat = owner.filter(told), flat.filter(told)
            wide = pc.match_substring(flat, "  ")
            if pc.any(wide).as_py():
                flat = pc.if_else(wide, pc.replace_substring_regex(flat, " +", " "), flat)
            whose = pc.take(langs, owner)
            table = pa.table({"lang": whose, "piece": flat, "n": pa.array(np.ones(len(flat), np.int64))})
            out = table.group_by(["lang", "piece"]).aggregate([("n", "sum")])
            yield from pa.table({"lang": out["lang"].cast(pa.string()), "piece": out["piece"].cast(pa.string()), "n": out["n_sum"]}).combine_chunks().to_batches(max_chunksize=20_000)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): every different piece of words, single blanks between them, and how often it comes."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


# -- the filter of frequent words and pairs ----------------------------------------------------------


def _word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(F.concat(lang, F.lit("\0"), word))


def _pair_hash(lang: Column, a: Column, b: Column) -> Column:
    h = _word_hash(lang, b)
    return _word_hash(lang, a).bitwiseXOR(F.shiftleft(h, 17).bitwiseOR(F.shiftrightunsigned(h, 47)))


def phrase_filter(hashes: DataFrame) -> np.ndarray:
    """The bits of all hashes(h): two each, FILTER_BITS in all, in words of 64."""
    h = F.col("h")
    bits = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FILTER_BITS - 1)))).alias("b"))
    rows = bits.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("w")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[rows["at"].to_numpy()] = rows["w"].to_numpy()
    return out


def _in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    def one(at: np.ndarray) -> np.ndarray:
        return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1)

    low = np.uint64(64 * len(bits) - 1)
    return (one(h & low) & one((h >> np.uint64(32)) & low)).astype(bool)


# -- a shard's automaton -----------------------------------------------------------------------------


class Automaton:
    """A bounded generalised suffix automaton of sequences of codes above 0, put one behind the other with a 0 before each.

    weight[i]: how often the sequence that place i is in comes. States are numbered; state s
    holds the endings of shortest[s] to longest[s] words of the window that ends at place[s],
    all of which end at the same places, count[s] by weight; link[s] is its suffix link, -1
    for the empty string. Substrings that several windows share are told by the first of them.
    """

    def __init__(self, codes: np.ndarray, weight: np.ndarray, depth: int):
        self.codes, self.depth = codes, depth
        ends = np.flatnonzero(codes)
        # window[d]: the word d places before each end, 0 from the sequence's border on
        window = [codes[ends].astype(np.int64)]
        for d in range(1, depth):
            back = np.where(window[-1] > 0, codes[np.maximum(ends - d, 0)], 0)
            window.append(back.astype(np.int64))
        # as many words of a window as have room make one sort key
        bits = int(codes.max(initial=0)).bit_length()
        room = 63 // max(1, bits)
        keys = []
        for d in range(0, depth, room):
            key = window[d]
            for w in window[d + 1 : d + room]:
                key = (key << bits) | w
            keys.append(key)
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        window = [w[order] for w in window]
        ends = ends[order]
        total = np.r_[0, np.cumsum(weight[ends])]
        n = len(ends)
        new = np.zeros(n, bool)
        new[:1] = True
        owner = np.full(n, -1, np.int64)  # the state of each window at the depth before
        parts = []
        made = 0
        parent_size = np.full(n, -1, np.int64)
        for d in range(depth):
            new[1:] |= window[d][1:] != window[d][:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, n])
            real = window[d][start] > 0
            same = real & (size == parent_size[start])  # ends where the shorter substring ends: the same state
            fresh = real & ~same
            ids = np.where(same, owner[start], -1)
            ids[fresh] = made + np.arange(int(fresh.sum()))
            parts.append((ids, start, size, real, fresh, owner[start]))
            made += int(fresh.sum())
            owner = np.repeat(ids, size)
            parent_size = np.repeat(np.where(real, size, -1), size)
        self.place, self.count, self.link = np.zeros(made, np.int64), np.zeros(made, np.int64), np.full(made, -1, np.int64)
        self.shortest, self.longest = np.zeros(made, np.int32), np.zeros(made, np.int32)
        for d, (ids, start, size, real, fresh, before) in enumerate(parts, 1):
            f = ids[fresh]
            self.place[f], self.link[f], self.shortest[f] = ends[start[fresh]], before[fresh], d
            self.count[f] = total[start[fresh] + size[fresh]] - total[start[fresh]]
            self.longest[ids[real]] = d

    def substrings(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The last places and counts of all different substrings of so many words."""
        holds = (self.shortest <= length) & (length <= self.longest)
        return self.place[holds], self.count[holds]


class Shard:
    """The pieces of one language that a task has read so far."""

    def __init__(self, lang: str):
        self.lang, self.size = lang, 0
        self.texts: list[pa.Array] = []
        self.times: list[np.ndarray] = []

    def add(self, texts: pa.Array, n: np.ndarray) -> None:
        self.texts.append(texts)
        self.times.append(n)
        self.size += int(pc.sum(pc.count_substring(texts, " ")).as_py()) + 2 * len(texts)

    def laid(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Codes of all words, from 1 on, with a 0 before each piece; how often each place's piece comes; the word of each code."""
        split = pc.split_pattern(pa.concat_arrays(self.texts), " ")
        words = pc.dictionary_encode(split.flatten())
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.zeros(len(words) + len(sizes), np.int32)
        told = np.ones(len(codes), bool)
        told[np.cumsum(sizes + 1) - sizes - 1] = False
        codes[told] = words.indices.to_numpy()
        codes[told] += 1
        return codes, np.repeat(np.concatenate(self.times), sizes + 1), pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary])

    def counted(self, lengths: tuple[int, ...], word_bits, pair_bits) -> Iterator[pa.RecordBatch]:
        import xxhash

        codes, weight, names = self.laid()
        h = np.zeros(0, np.uint64)
        if word_bits is not None:
            top = f"{self.lang}\0".encode()
            h = np.array([0, *(xxhash.xxh64_intdigest(top + w.encode(), 42) for w in names[1:].to_pylist())], np.uint64)
        if word_bits is not None:
            fine = _in_filter(word_bits, h)
            fine[0] = False
            codes = np.where(fine[codes], codes, 0)
        if pair_bits is not None:
            a, b = h[codes[:-1]], h[codes[1:]]
            bound = (codes[:-1] > 0) & (codes[1:] > 0)
            bound[bound] = _in_filter(pair_bits, a[bound] ^ ((b[bound] << np.uint64(17)) | (b[bound] >> np.uint64(47))))
            left, right = np.r_[False, bound], np.r_[bound, False]
            # a 0 comes between words of a rare pair; words without any frequent pair go
            alone = ~left & ~right
            keep = ~alone | (codes == 0)
            starts = np.flatnonzero(~left & right)
            codes = np.where(keep & (codes > 0) & ~alone, codes, 0)
            codes, weight = np.insert(codes, starts, 0), np.insert(weight, starts, 0)
        # numbers of the words that are left, as small as can be
        used = np.zeros(len(names), bool)
        used[0], used[codes] = True, True
        names, codes = names.filter(pa.array(used)), (np.cumsum(used, dtype=np.int32) - np.int32(1))[codes]
        automaton = Automaton(codes, weight, max(lengths))
        for k in lengths:
            place, n = automaton.substrings(k)
            for at in range(0, len(place), 20_000):
                p = place[at : at + 20_000]
                said = [pc.take(names, pa.array(codes[p - d])) for d in range(k - 1, -1, -1)]
                phrase = said[0] if k == 1 else pc.binary_join_element_wise(*said, " ")
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(p), pa.string()), phrase, pa.array(n[at : at + 20_000])], ["lang", "phrase", "n"])


def phrase_counts(found: DataFrame, lengths: tuple[int, ...], word_filter: np.ndarray | None = None, pair_filter: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, n): all phrases of the given lengths in found(lang, piece, n), whose words and pairs the filters hold.

    Each shard's automaton gives its own counts, and one aggregation adds them up.
    """
    sc = found.sparkSession.sparkContext
    words, pairs = (None if x is None else sc.broadcast(x) for x in (word_filter, pair_filter))
    most = SHARD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}
        filters = tuple(None if x is None else x.value for x in (words, pairs))
        for b in batches:
            lang, text, n = b.column(0), b.column(1), b.column(2).to_numpy()
            for x in pc.unique(lang).to_pylist():
                own = pc.equal(lang, x)
                shard = shards.get(x) or shards.setdefault(x, Shard(x))
                shard.add(text.filter(own), n[own.to_numpy(zero_copy_only=False)])
                if shard.size > most:
                    yield from shards.pop(x).counted(lengths, *filters)
        for shard in shards.values():
            yield from shard.counted(lengths, *filters)

    return found.mapInArrow(run, PHRASE).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# -- frequent phrases, their scores and ranks --------------------------------------------------------


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, n, k words), single words among them, and (lang, n) of all word occurrences."""
    found = stored(pieces(docs), "pieces")
    words = stored(phrase_counts(found, (1,)), "words")
    often = words.where(F.col("n") >= min_count)
    word_filter = phrase_filter(often.select(_word_hash(F.col("lang"), F.col("phrase")).alias("h")))
    pairs = stored(phrase_counts(found, (2,), word_filter).where(F.col("n") >= min_count), "pairs")
    out = often.withColumn("k", F.lit(1)).unionByName(pairs.withColumn("k", F.lit(2)))
    if most_words > 2:
        side = F.split("phrase", " ")
        pair_filter = phrase_filter(pairs.select(_pair_hash(F.col("lang"), side[0], side[1]).alias("h")))
        longer = phrase_counts(found, tuple(range(3, most_words + 1)), word_filter, pair_filter).where(F.col("n") >= min_count)
        out = out.unionByName(longer.withColumn("k", F.size(F.split("phrase", " "))))
    return stored(out, "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _words(first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more: the cut of least score, the earliest of equals."""
    cuts = phrases.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", F.split("phrase", " ").alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _words(1, F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    both = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r"))
    return both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def subsumers(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the count of the most frequent frequent phrase that is one word longer.

    A phrase's suffix link drops its first word, the mirror link its last. A phrase of more
    words holds one of one word more that is no rarer, so the links of one step tell all.
    """
    w = phrases.where("k > 2").select("lang", "n", "k", F.split("phrase", " ").alias("w"))
    links = w.select("lang", "n", F.explode(F.array(_words(2, F.col("k") - 1), _words(1, F.col("k") - 1))).alias("phrase"))
    return links.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def mined(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first collocations.

    docs(text, lang): null texts count as empty, a null lang as und, every row counts, repeated
    ones too; other columns are ignored. Phrases of MOST_WORDS words at most, within pieces.
    Score floor(SCALE * a / (l + r)) at the phrase's worst cut. Ranks by score, then count,
    both falling, then by the phrase's bytes. Without frequent phrases no rows.
    """
    phrases, totals = frequent(docs, min_count)
    longer = subsumers(phrases)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored(phrases).join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * wide("most") < SUBSUMED * wide("a")))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    groups = min(salted(docs.sparkSession), RANK_GROUPS)
    some = kept.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*by))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
w AS (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> '') AS w, row_number() OVER () AS i FROM p),
e AS (SELECT lang, i, unnest(range(1, len(w) + 1)) AS j, w FROM w WHERE len(w) > 0),
g AS (SELECT lang, unnest([1, 2, 3, 4]) AS k, j, w FROM e),
c AS (SELECT lang, k, array_to_string(w[j:j + k - 1], ' ') AS phrase, count(*) AS a FROM g WHERE j + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM c WHERE a >= 30),
s AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
u AS (SELECT s.lang, s.phrase, s.a, s.k, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * s.a) // (l.a::HUGEINT + r.a) AS score FROM s
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[:cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
sub AS (SELECT lang, a, w, unnest(range(1, k)) AS n, k FROM f WHERE k > 2),
sub2 AS (SELECT lang, a, w, n, unnest(range(1, k - n + 2)) AS j FROM sub WHERE n > 1),
big AS (SELECT lang, array_to_string(w[j:j + n - 1], ' ') AS phrase, max(a) AS most FROM sub2 GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN big USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM rk JOIN total USING (lang) WHERE rank <= 2000
"""
