"""Words for whole lines and ranked words for targets, over a sharded index of the word list.

`index` cuts the word list, in order of its units, into shards of at most SHARD_ROWS rows; the
executors make them. While all shards together are small they are broadcast, and a task walks
them (`wordtree`) with many targets or lines at once. A larger index stays a table: each target
first meets the shard that may hold its nearest words, then those whose least distance does not
pass what it has found, in batches that are joined with the shard; the best of all shards are
merged. No pair of target and word is ever a row.

A line is covered prefix by prefix. A run of syllables needs its word only if the word may cost
no more than the cheapest cover of the run by shorter words, so walks end at that limit, and
are taken up again with a higher one only for runs whose words within the limit are all used.

Sums are those of the joins in `distance`: unit by unit, then the edits of both sides together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kana
from ..plans.store import stored
from ..sources.wordlist import id_order
from .distance import normalized_weights
from .segment import DEFAULTS, FILLER
from .wordtree import EPS, GROUP, Asked, Ways, Words, lengths_of

#: Word rows of a shard, and bytes of all shards up to which they are broadcast.
SHARD_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Targets that meet a shard in one row of the join.
BATCH = 1_000
#: First limit of a walk, and what is added to it at least; for targets, and for runs of lines.
LIMIT, STEP = 32.0, 24.0
COVER_LIMIT, COVER_STEP = 40.0, 16.0
#: What is added to the limits of runs where no word may come twice, so that few must be taken up again.
SPARE = 4.0
#: Syllables of lines that are covered together, and starts of runs that are walked together. The more, the more they share.
UNITS, STARTS = 100_000, 4_096
LOCK = "struct<i:int,t:int,id:string,sim:double,surface:string,pronunciation:array<string>,kana:string,original:string>"
GENERATED = "song long, line long, word int, i int, t int, id string, sim double, score double, filler boolean, locked boolean, surface string, pronunciation array<string>, kana string, original string, originalkana string, original_surface string, vcost int"
RANKED = "target string, id string, sim double, n_units int, seq long, rank int"
COLUMNS = [f.split()[0] for f in GENERATED.replace(", ", ",").split(",")]


class Index(NamedTuple):
    """shards(shard, firsts, rows, blob): firsts are the codes of the rows' first units."""

    shards: DataFrame
    words: DataFrame
    names: list[str]
    grid: np.ndarray
    variation_cost: float
    bytes: int
    count: int

    def fits(self) -> bool:
        return self.bytes <= BROADCAST_BYTES

    def shared(self):
        """A broadcast of all shards, which `held` opens."""
        blobs = [bytes(r.blob) for r in self.shards.sort("shard").select("blob").collect()]  # at most BROADCAST_BYTES
        return self.shards.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, blobs, self.names, self.grid, self.variation_cost))


_HELD: dict[str, Words] = {}


def held(shared) -> Words:
    """This worker's words of a broadcast index."""
    token, *parts = shared.value
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Words(*parts)
    return _HELD[token]


def index(words: DataFrame, dist: DataFrame, variation_cost: float = 0.0, shard_rows: int | None = None) -> Index:
    """The index of a word table (id, n_units, seq, units, vcost[, surface, original, kana]) of any length.

    dist(u1, u2, dist) has a fixed size. Rows without units, or with a unit that dist has not,
    match nothing and are left out.
    """
    rows = dist.collect()  # one row for each pair of units
    names = sorted({r.u1 for r in rows})
    place = {n: i for i, n in enumerate(names)}
    grid = np.full((len(names), len(names)), np.inf)
    for r in rows:
        if r.u2 in place:
            grid[place[r.u1], place[r.u2]] = r.dist
    per_shard = shard_rows or SHARD_ROWS
    table = F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), F.array(*(F.lit(i) for i in range(len(names)))).cast("array<int>"))
    extra = [F.col(c).cast("string").alias(c) if c in words.columns else F.lit(None).cast("string").alias(c) for c in ("surface", "original", "kana")]
    coded = words.select(F.col("id").cast("string").alias("id"), F.col("n_units").cast("int").alias("n_units"), F.col("seq").cast("long").alias("seq"), F.col("vcost").cast("int").alias("vcost"), F.transform("units", lambda u: F.try_element_at(table, u)).alias("codes"), *extra)
    coded = stored(coded.where((F.size("codes") > 0) & F.forall("codes", lambda c: c.isNotNull())))
    parts = max(1, -(-coded.count() // per_shard))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def shard(t: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            firsts = sorted({c[0] for c in t["codes"].to_pylist()})
            return pa.RecordBatch.from_arrays([pa.array([firsts], pa.list_(pa.int32())), pa.array([len(t)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["firsts", "rows", "blob"])

        for b in batches:
            waiting.append(b)
            while sum(x.num_rows for x in waiting) > per_shard:
                t = pa.Table.from_batches(waiting)
                yield shard(t.slice(0, per_shard).combine_chunks())
                waiting = t.slice(per_shard).to_batches()
        if sum(x.num_rows for x in waiting):
            yield shard(pa.Table.from_batches(waiting).combine_chunks())

    sorted_ = coded.repartitionByRange(parts, "codes", "seq").sortWithinPartitions("codes", "n_units", "seq")
    shards = stored(sorted_.mapInArrow(build, "firsts array<int>, rows long, blob binary").withColumn("shard", F.monotonically_increasing_id()))
    size = shards.agg(F.sum(F.length("blob")), F.count("*")).first()
    return Index(shards, coded, names, grid, float(variation_cost), int(size[0] or 0), int(size[1]))


def further(limit: float, step: float = STEP) -> float:
    """The next limit: a walk grows manifold with each step."""
    return max(limit + step, 1.25 * limit)


def _listed(x) -> list:
    return [] if x is None or isinstance(x, float) else list(x)


def _variants(units: Column) -> Column:
    return F.transform(units, lambda u: F.struct(u.alias("s"), kana.syllable_variants(u).alias("v")))


def _number(ways: Ways, syllables) -> list[int]:
    return [ways.add(x["s"], [(list(v["units"]), int(v["cost"])) for v in x["v"]]) for x in _listed(syllables)]


def _padded(rows: list[list], empty) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), empty)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


# -- ranked words of targets -------------------------------------------------------------------------


def ranks(words: Words, targets: list[tuple[list, list | None]], k: int | None, bounds: list[float] | None = None) -> list[list[tuple[float, int, int]]]:
    """The first k, or all, (sum, word, row) of each target (syllables with ways, weights or None), in rank order, with all that equal the k-th.

    The limit of a walk rises until it holds k words. bounds: sums beyond which no word is asked for.
    """
    out: list[list[tuple[float, int, int]]] = [[] for _ in targets]
    if not len(words.n_units):
        return out
    ways = Ways(words.place)
    numbers = [_number(ways, s) for s, _ in targets]
    for weighted in (False, True):
        group = [i for i, (_, w) in enumerate(targets) if numbers[i] and (w is not None) == weighted]
        group.sort(key=lambda i: numbers[i])
        for c in range(0, len(group), GROUP):
            some = group[c : c + GROUP]
            weights = _padded([list(map(float, targets[i][1])) for i in some], 0.0) if weighted else None
            asked = Asked(_padded([numbers[i] for i in some], -1), weights)
            ends = [int(asked.node[x, len(numbers[i]) - 1]) for x, i in enumerate(some)]
            most = words.most * max(1.0, float(weights.max())) if weighted else words.most
            lengths = None
            open_ = list(range(len(some)))
            now = most if k is None else LIMIT
            while open_:
                limit = np.full(asked.size, -np.inf)
                for x in open_:
                    limit[ends[x]] = max(limit[ends[x]], min(now, most, bounds[some[x]] if bounds else np.inf))
                hits = list(words.walk(ways, asked, limit))
                if lengths is None:
                    lengths = lengths_of(ways, asked)
                got = words.ranked(*(np.concatenate(x) for x in zip(*hits)), lengths.__getitem__) if hits else {}
                left = []
                for x in open_:
                    found = got.get(ends[x], [])
                    if k is None or len(found) >= k or now >= most or (bounds and now >= bounds[some[x]]):
                        if k is not None and len(found) > k:
                            found = [f for f in found if f[0] <= found[k - 1][0]]
                        out[some[x]] = found
                    else:
                        left.append(x)
                open_ = left
                now = further(now)
    return out


def nearest(targets: DataFrame, words: DataFrame | Index, dist: DataFrame | None = None, variation_cost: float = 0.0, k: int | None = None, weights: Column | None = None) -> DataFrame:
    """(target, id, sim, n_units, seq, rank): each target's words in rank order, the first k or all.

    targets(target, syllables); weights: a column of targets with one weight for each syllable,
    ignored where it is not valid. words: a word table, or its index. The same result as
    distance.ranked(distance.nearest(..)), without rows for pairs. Targets are told by their
    name: rows that repeat one are ranked once each by a small index, together by a large one.
    """
    found = words if isinstance(words, Index) else index(words, dist, variation_cost)
    w = F.lit(None).cast("array<double>") if weights is None else normalized_weights(weights, F.size("syllables"))
    rows = targets.select("target", _variants(F.col("syllables")).alias("ways"), w.alias("w"))
    if not found.fits():
        return _nearest_by_shards(rows, found, k)
    shared = found.shared()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held(shared)
        for pdf in batches:
            for c in range(0, len(pdf), GROUP):
                some = pdf.iloc[c : c + GROUP]
                got = ranks(own, [(_listed(r.ways), _listed(r.w) or None) for r in some.itertuples()], k)
                out = [(t, s, w, r, i) for t, found in zip(some["target"], got) for i, (s, w, r) in enumerate(found[:k], 1)]
                if not out:
                    continue
                told = np.array([x[3] for x in out], np.int64)
                ids = own.ids.take(pa.array([x[2] for x in out], pa.int64())).to_pylist()
                yield pd.DataFrame({"target": [x[0] for x in out], "id": ids, "sim": [x[1] for x in out], "n_units": own.n_units[told].astype("int32"), "seq": own.seq[told], "rank": np.array([x[4] for x in out], "int32")})

    return rows.repartition(max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "target").mapInPandas(run, RANKED)


_SHARED = "target string, id string, sim double, n_units int, seq long, lengths array<int>"


def _nearest_by_shards(rows: DataFrame, found: Index, k: int | None) -> DataFrame:
    """nearest over an index that is not broadcast. rows(target, ways, w)."""
    spark = rows.sparkSession
    # each shard's first units: a few hundred bits for SHARD_ROWS word rows
    firsts = {r.shard: np.array(r.firsts) for r in found.shards.select("shard", "firsts").collect()}
    directory = spark.sparkContext.broadcast((list(firsts), list(firsts.values()), found.names, found.grid, found.variation_cost))
    rows = stored(rows)
    batches = max(1, -(-rows.count() // BATCH))

    def least(ways, w) -> np.ndarray:
        """The least that a word of each shard can cost: its first unit against those of the target's ways, and their edits."""
        shards, codes, names, grid, cost = directory.value
        place = {u: i for i, u in enumerate(names)}
        out = np.full(len(shards), np.inf)
        silent = 0
        for x, way in enumerate(ways):
            for v in way["v"]:
                if len(v["units"]) and (u := place.get(v["units"][0])) is not None:
                    row = grid[u] * (w[x] if w else 1.0)
                    out = np.minimum(out, [row[c].min() + (silent + v["cost"]) * cost for c in codes])
            quiet = [v["cost"] for v in way["v"] if not len(v["units"])]
            if not quiet:
                break
            silent += min(quiet)
        return out

    def deal(first: bool):
        def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shards = directory.value[0]
            for pdf in batches_:
                out = []
                for r in pdf.itertuples():
                    low = least(_listed(r.ways), _listed(r.w))
                    home = int(np.argmin(low)) if len(low) else -1
                    bound = np.inf if first else r.bound
                    for s in [home] if first else range(len(low)):
                        if s >= 0 and np.isfinite(low[s]) and low[s] <= bound + 1e-6 and (first or s != home):
                            out.append((r.target, r.ways, r.w, bound, shards[s]))
                yield pd.DataFrame(out, columns=["target", "ways", "w", "bound", "shard"])

        return run

    pair = f"target string, ways {rows.schema['ways'].dataType.simpleString()}, w array<double>, bound double, shard long"

    def searched(pairs: DataFrame) -> DataFrame:
        grouped = pairs.groupBy("shard", F.pmod(F.xxhash64("target"), F.lit(batches)).alias("batch")).agg(F.collect_list(F.struct("target", "ways", "w", "bound")).alias("asked"))
        names, grid, cost = found.names, found.grid, found.variation_cost

        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_:
                for x in range(b.num_rows):
                    own = Words([b.column(1)[x].as_py()], names, grid, cost)
                    asked = b.column(0)[x].as_py()
                    got = ranks(own, [(a["ways"], a["w"]) for a in asked], k, [a["bound"] for a in asked])
                    told = [(a["target"], s, w, r) for a, f in zip(asked, got) for s, w, r in f]
                    at = np.array([t[3] for t in told], np.int64)
                    ways = {a["target"]: _lengths(a["ways"], own.place) for a in asked}
                    ids = own.ids.take(pa.array([t[2] for t in told], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.string()), ids.cast(pa.string()), pa.array([t[1] for t in told], pa.float64()), pa.array(own.n_units[at].astype(np.int32)), pa.array(own.seq[at].astype(np.int64)), pa.array([ways[t[0]] for t in told], pa.list_(pa.int32()))], [f.split()[0] for f in _SHARED.split(", ")])

        return grouped.join(found.shards.select("shard", "blob"), "shard").select("asked", "blob").mapInArrow(run, _SHARED)

    near = stored(searched(rows.mapInPandas(deal(True), pair)))
    if k is None:
        bound = F.lit(float("inf"))
        asked = rows.withColumn("bound", bound)
    else:
        place = F.row_number().over(Window.partitionBy("target").orderBy("sim"))
        kth = near.withColumn("r", place).where(F.col("r") == k).groupBy("target").agg(F.min("sim").alias("bound"))
        asked = rows.join(kth, "target", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    every = near.unionByName(searched(asked.mapInPandas(deal(False), pair)))
    best = every.groupBy("target", "id").agg(F.min(F.struct("sim", (-F.col("n_units")).alias("n"), (-F.col("seq")).alias("s"))).alias("x"), F.first("lengths").alias("lengths"))
    best = best.select("target", "id", "x.sim", (-F.col("x.n")).alias("n_units"), (-F.col("x.s")).alias("seq"), "lengths")
    # where ids are no numbers, equals are told apart by the id's first place among words of the target's lengths
    first = found.words.groupBy("id", "n_units").agg(F.min("seq").alias("seq")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n_units", "seq"))).alias("places"))
    seen = F.get(F.filter("places", lambda p: F.array_contains("lengths", p["n_units"])), F.lit(0))
    out = best.join(first, "id").withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("sim", *id_order(F.col("id"), seen))))
    return (out if k is None else out.where(F.col("rank") <= k)).select("target", "id", "sim", "n_units", "seq", "rank")


def _lengths(ways: list, place: dict[str, int]) -> list[int]:
    bits = 1
    for way in ways:
        now = 0
        for v in way["v"]:
            if all(u in place for u in v["units"]):
                now |= bits << len(v["units"])
        bits = now
    return [n for n in range(1, bits.bit_length()) if bits >> n & 1]


# -- covers of lines -----------------------------------------------------------------------------------


class Covers:
    """Covers of lines, prefix by prefix."""

    def reach(self, line: list[int]) -> list[int]:
        """For each start the end of its longest run that a word can match."""
        least = np.array([min((len(u) for u, _ in self.ways.list[k]), default=1 << 20) for k in line], np.int64)
        total = np.r_[0, np.cumsum(least)]
        return [int(np.searchsorted(total, total[i] + self.longest, "right")) - 1 for i in range(len(line))]

    def adjusted(self, breaks: set[int], n: int, e: int) -> float:
        return -self.p["SAME_PHRASE_BREAK_REWARD"] if e in breaks else self.p["MID_PHRASE_BREAK_PENALTY"] if e != n else 0.0

    def cover(self, line: list[int], weights, breaks: set[int], busy: set[int] | None, s: int, t: int) -> list[tuple]:
        """The cover of syllables s to t, prefix by prefix, as (i, t, word or None, row or None, sim, score); with busy words neither busy nor on the prefix's own path come.

        Each end takes the least total over starts, of equal ones the earliest start and the
        filler before the word. That is the method, not an optimum over all covers where words
        may not repeat.
        """
        n, each = len(line), self.p["WORD_NUMBER_PENALTY"]
        ends = self.reach(line)
        starts: dict[int, list[int]] = {}
        for i in range(s, t):
            for e in range(i + 1, min(t, ends[i]) + 1):
                starts.setdefault(e, []).append(i)
        best: dict[int, tuple[float, tuple | None, frozenset]] = {s: (0.0, None, frozenset())}
        for e in range(s + 1, t + 1):
            base = best[e - 1][0]
            # (total, start, filler before word), and what it takes
            chosen = (base + FILLER + each, 2 * (e - 1))
            step = (e - 1, e, None, None, FILLER, FILLER)
            add = self.adjusted(breaks, n, e)
            for i in reversed(starts.get(e, ())):
                base, _, own = best[i]
                slack = chosen[0] - base - each - add
                got = self.first_free(line, weights, i, e, slack, busy, own)
                if got is None:
                    continue
                score = got[0] - self.p["SAME_PHRASE_BREAK_REWARD"] if e in breaks else got[0] + (self.p["MID_PHRASE_BREAK_PENALTY"] if e != n else 0.0)
                now = (base + score + each, 2 * i + 1)
                if now < chosen:
                    chosen, step = now, (i, e, got[1], got[2], got[0], score)
            own = best[step[0]][2]
            best[e] = (chosen[0], step, own | {step[2]} if busy is not None and step[2] is not None else own)
        out = []
        at = t
        while at > s:
            step = best[at][1]
            out.append(step)
            at = step[0]
        return out[::-1]


class Line(NamedTuple):
    row: object
    numbers: list[int]
    weights: list[float] | None
    breaks: set[int]
    locks: list
    free: list[tuple[int, int]]


def _line(ways: Ways, r) -> Line:
    numbers = _number(ways, r.ways)
    locks = sorted(_listed(r.locks), key=lambda x: x["i"])
    free, at = [], 0
    for lock in locks:
        if at < lock["i"]:
            free.append((at, lock["i"]))
        at = max(at, lock["t"])
    if at < len(numbers):
        free.append((at, len(numbers)))
    return Line(r, numbers, list(map(float, _listed(r.weights))) or None, set(map(int, _listed(r.breaks))), locks, free)


def _rows(words, line: Line, busy: set | None, cover: Callable[[int, int], list[tuple]]) -> list[tuple]:
    """Result rows of one line, by the cover of each of its free stretches; words taken by it are added to busy."""
    r = line.row
    units = _listed(r.units)
    surfaces = _listed(r.surfaces) or [""] * len(units)
    if busy is not None:
        busy |= {n for x in line.locks if (n := words.numbered(x["id"])) is not None}
    found: list[tuple[tuple, object]] = []
    free = iter(line.free)
    at = 0
    for lock in [*line.locks, None]:
        end = len(units) if lock is None else lock["i"]
        if at < end:
            path = cover(*next(free))
            found += [(w, None) for w in path]
            if busy is not None:
                busy |= {w[2] for w in path if w[2] is not None}
        if lock is not None:
            found.append(((lock["i"], lock["t"], None, None, lock["sim"], lock["sim"]), lock))
            at = max(at, lock["t"])
    out = []
    for k, ((i, t, word, row, sim, score), lock) in enumerate(found):
        said, shown = "".join(units[i:t]), "".join(surfaces[i:t])
        told = lambda name, other: other if lock[name] is None else lock[name]  # noqa: B023, E731
        if lock is not None:
            own = (lock["id"], sim, score, lock["id"] is None, True, told("surface", lock["id"] or said), list(told("pronunciation", units[i:t])), told("kana", said), told("original", ""), said, shown, None)
        elif row is None:
            own = (None, sim, score, True, False, said, units[i:t], said, "", said, shown, None)
        else:
            w = words.told(row)
            units_of = [words.names[c] for c in w["codes"]]
            own = (w["id"], sim, score, False, False, w["surface"] or w["id"], units_of, w["kana"] or "".join(units_of), w["original"] or "", said, shown, w["vcost"])
        out.append((r.song, r.line, k, i, t, *own))
    return out


def line_rows(lines: DataFrame) -> DataFrame:
    """lines(song, line, units[, breaks, weights, surfaces, locks]) with the ways of their syllables, valid weights alone, and whole locks."""
    blank = {"breaks": "array<int>", "surfaces": "array<string>"}
    have = [F.col(c).cast(kind).alias(c) if c in lines.columns else F.lit(None).cast(kind).alias(c) for c, kind in blank.items()]
    weights = normalized_weights(F.col("weights"), F.size("units")) if "weights" in lines.columns else F.lit(None).cast("array<double>")
    if "locks" in lines.columns:
        given = {f.name for f in lines.schema["locks"].dataType.elementType.fields}
        fields = [f.split(":", 1) for f in ("i:int", "t:int", "id:string", "sim:double", "surface:string", "pronunciation:array<string>", "kana:string", "original:string")]
        whole = F.transform("locks", lambda x: F.struct(*((x[n] if n in given else F.lit(None)).cast(kind).alias(n) for n, kind in fields)))
    else:
        whole = F.lit(None).cast(f"array<{LOCK}>")
    return lines.select(F.col("song").cast("long").alias("song"), F.col("line").cast("long").alias("line"), "units", _variants(F.col("units")).alias("ways"), weights.alias("weights"), *have, whole.alias("locks"))


class Batch(Covers):
    """Covers of many lines by a worker's words; the runs of all lines are walked together.

    A word of a sum within a limit costs no more than half of it for the run's first half, or for
    its second half. So a run is walked from both ends, and a walk may spend half the limit until
    it has passed the half of the run: far fewer pairs of nodes come up than from one end.
    """

    def __init__(self, words: Words, parameters: dict, ways: Ways, lines: list[Line], busy: list[set | None]):
        self.words, self.p, self.ways, self.lines, self.busy = words, parameters, ways, lines, busy
        self.back, self.stale = ways.turned(), True
        self.longest = int(words.n_units.max(initial=0))
        size = [len(x.numbers) for x in lines]
        self.first = np.cumsum([0, *size])
        n = int(self.first[-1])
        self.syllable = np.fromiter((k for x in lines for k in x.numbers), np.int64, n)
        self.weight = np.ones(n)
        #: By syllable: its line, and the runs that begin there.
        self.line, self.runs = np.repeat(np.arange(len(lines)), size), np.zeros(n, np.int64)
        for x, a in zip(lines, self.first):
            if x.weights:
                self.weight[a : a + len(x.weights)] = x.weights
            if self.longest:
                ends = self.reach(x.numbers)
                for s, t in x.free:
                    self.runs[a + s : a + t] = [max(0, min(t, ends[i]) - i) for i in range(s, t)]
        self.most = int(self.runs.max(initial=0))
        self.weighted = bool((self.weight != 1.0).any())
        #: By size - 1 and start: the run's number, equal for equal runs, -1 where there is none; and what its word adds to the sum.
        self.number = np.full((self.most, n), -1, np.int64)
        self.add = np.full((self.most, n), np.inf)
        self.kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64))
        if not self.most:
            self.done = np.zeros(0)
            return
        starts = np.flatnonzero(self.runs)
        asked = self.asked(*self.windows(starts, 1))
        for k in range(self.most):
            some = self.runs[starts] > k
            self.number[k, starts[some]] = asked.node[some, k]
        #: By number of a syllable: the least units of a way, and the most that it can cost.
        self.least = np.array([min((len(u) for u, _ in x), default=0) for x in ways.list], np.int64)
        dear = words.dearest()
        costs = [max((float(dear[u].sum()) + e * words.cost for u, e in x), default=0.0) for x in ways.list]
        cost = np.array(costs)[self.syllable] * np.maximum(self.weight, 1.0)
        #: By size - 1 and start: a bound of any word's sum.
        self.top = np.full((self.most, n), np.inf)
        so_far = np.r_[0.0, np.cumsum(cost)]
        for k in range(self.most):
            self.top[k, : n - k] = so_far[k + 1 :] - so_far[: n - k] + words.cost * float(words.vcost.max())
        self.top += 1e-6 * (1.0 + so_far[-1] / 1e6)
        #: By size - 1 and start: the mean weight, by which limits rise, so that light runs do not find all words at once.
        self.scale = np.ones((self.most, n) if self.weighted else (1, 1))
        if self.weighted:
            heavy = np.r_[0.0, np.cumsum(self.weight)]
            for k in range(self.most):
                self.scale[k, : n - k] = (heavy[k + 1 :] - heavy[: n - k]) / (k + 1)
        each = parameters["WORD_NUMBER_PENALTY"]
        # by last syllable of a run: whether its line ends there, and whether a phrase does
        last, broken = np.zeros(n, bool), np.zeros(n, bool)
        for x, a, b in zip(lines, self.first.tolist(), self.first[1:].tolist()):
            last[b - 1 : b] = True
            broken[[a + e - 1 for e in x.breaks if 0 < e <= b - a]] = True
        for k in range(self.most):
            c = np.flatnonzero(self.number[k] >= 0)
            self.add[k, c] = np.where(broken[c + k], -parameters["SAME_PHRASE_BREAK_REWARD"], np.where(last[c + k], 0.0, parameters["MID_PHRASE_BREAK_PENALTY"])) + each
        #: How far each run's words are known.
        self.done = np.full(asked.size, -np.inf)
        self.lengths = None if words.whole.all() else lengths_of(ways, asked)
        order = np.lexsort((*self.windows(starts, 1)[0].T[::-1], self.weight[starts] != 1.0))
        self.forward = starts[order]
        #: By last syllable: the runs that end there.
        self.ending = np.zeros(n, np.int64)
        for k in range(self.most):
            self.ending[np.flatnonzero(self.number[k] >= 0) + k] = k + 1
        ends = np.flatnonzero(self.ending)
        self.backward = ends[np.lexsort((*self.windows(ends, -1)[0].T[::-1], self.weight[ends] != 1.0))]

    def windows(self, at: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Syllables and weights of the longest run from each place on, or backwards from it."""
        k = np.arange(self.most)
        there = k < (self.runs if way > 0 else self.ending)[at][:, None]
        place = np.where(there, at[:, None] + way * k, 0)
        return np.where(there, self.syllable[place], -1), np.where(there, self.weight[place], 0.0)

    def asked(self, syllables: np.ndarray, weights: np.ndarray) -> Asked:
        return Asked(syllables, weights if self.weighted and (weights[syllables >= 0] != 1.0).any() else None)

    def find(self, wanted: np.ndarray) -> None:
        """Finds all words of each run up to the limit wanted[size - 1, start], -inf where it is not asked for."""
        self.stale = True
        limit = np.full(len(self.done), -np.inf)
        open_ = np.isfinite(wanted)
        np.maximum.at(limit, self.number[open_], wanted[open_])
        wanted = np.where(self.number >= 0, limit[self.number], -np.inf)
        opened = np.isfinite(limit)
        n, most = self.number.shape[1], self.most
        size = np.arange(1, most + 1)
        half = np.where(size > 2, (size + 1) // 2, 0)
        found = []
        for way, places, ways, trees in ((1, self.forward, self.ways, self.words.both()[0]), (-1, self.backward, self.back, self.words.both()[1])):
            if way > 0:
                top, number = wanted, self.number
                halves = half
            else:
                top, number = np.full((most, n), -np.inf), np.full((most, n), -1, np.int64)
                for k in range(2, most):
                    top[k, k:], number[k, k:] = wanted[k, : n - k], self.number[k, : n - k]
                halves = size - half
            places = places[np.isfinite(top[:, places]).any(axis=0)]
            for g in range(0, len(places), STARTS):
                part = places[g : g + STARTS]
                mine = top[:, part]
                # no further than the longest run that is asked for
                longest = most - np.argmax(np.isfinite(mine[::-1]), axis=0)
                syllables, weights = self.windows(part, way)
                syllables[np.arange(most) >= longest[:, None]] = -1
                asked = self.asked(syllables[:, : longest.max()], weights[:, : longest.max()])
                own, run = np.full(asked.size, -np.inf), np.full(asked.size, -1, np.int64)
                # by asked node and the units that follow at least
                within = np.full((asked.size, self.longest + 1), -np.inf)
                spans = within.shape[1]
                least = np.cumsum(np.where(syllables >= 0, self.least[syllables], 0), axis=1)
                for d in range(int(longest.max())):
                    there = asked.node[:, d] >= 0
                    node = asked.node[there, d]
                    for k in range(d, int(longest.max())):
                        some = np.flatnonzero(there & np.isfinite(mine[k]))
                        follow = np.minimum(least[some, k] - least[some, d], spans - 1)
                        np.maximum.at(within.reshape(-1), asked.node[some, d] * spans + follow, (0.5 if halves[k] > d else 1.0) * mine[k, some])
                    run[node] = number[d, part[there]]
                    np.maximum.at(own, node, mine[d, there])
                within = np.maximum.accumulate(within, axis=1)
                for node, row, sums in self.words.walk(ways, asked, own, within, trees):
                    found.append((run[node], row, sums, np.full(len(row), way < 0)))
        kept = ~opened[self.kept[0]]
        old = tuple(x[kept] for x in self.kept)
        if found:
            node, row, sums, turned = (np.concatenate(x) for x in zip(*found))
            if not self.words.exact or self.weighted:
                node, row, sums = self._summed(node, row, sums, turned)
            got = self.words.ordered(node, row, sums, None if self.lengths is None else self.lengths.__getitem__)
            near = got[2] <= limit[got[0]] + EPS
            if self.p["DUPLICATE"]:  # the first word will do
                near &= np.r_[True, got[0][1:] != got[0][:-1]] if len(near) else near
            old = tuple(np.concatenate((a, b[near])) for a, b in zip(old, got))
        order = np.argsort(old[0], kind="stable")
        self.kept = tuple(x[order] for x in old)
        self.done[opened] = limit[opened]

    def _summed(self, node: np.ndarray, row: np.ndarray, sums: np.ndarray, turned: np.ndarray):
        """What only the walk from the end has found is summed again from the beginning, as all others are."""
        key = node * len(self.words.n_units) + row
        more = np.flatnonzero(turned)
        more = more[np.unique(key[more], return_index=True)[1]]
        more = more[~np.isin(key[more], key[~turned])]
        c, k = np.zeros(len(self.done), np.int64), np.zeros(len(self.done), np.int64)
        for d in range(self.most):
            there = np.flatnonzero(self.number[d] >= 0)
            c[self.number[d, there]], k[self.number[d, there]] = there, d + 1
        parts = [np.zeros(0)]
        for a in range(0, len(more), 50_000):
            some = more[a : a + 50_000]
            syllables, weights = self.windows(c[node[some]], 1)
            syllables[np.arange(self.most) >= k[node[some]][:, None]] = -1
            parts.append(self.words.sums(self.ways, syllables, weights if self.weighted else None, row[some]))
        return np.r_[node[~turned], node[more]], np.r_[row[~turned], row[more]], np.r_[sums[~turned], np.concatenate(parts)]

    def free(self) -> np.ndarray:
        """By size - 1 and start the sum of the first word that is not busy, inf where none is known."""
        node, _, sums, word = self.kept
        begin = np.searchsorted(node, np.arange(len(self.done) + 1))
        out = np.full(self.number.shape, np.inf)
        k, c = np.nonzero(self.number >= 0)
        at, end = begin[self.number[k, c]], begin[self.number[k, c] + 1]
        some = np.flatnonzero(at < end)
        taken = None
        if self.busy and self.busy[0] is not None:
            n = len(self.words.ids)
            taken = np.sort(np.fromiter((x * n + w for x, b in enumerate(self.busy) for w in b), np.int64))
            left = some
            while len(left) and len(taken):
                key = self.line[c[left]] * n + word[at[left]]
                left = left[taken[np.minimum(np.searchsorted(taken, key), len(taken) - 1)] == key]
                at[left] += 1
                left = left[at[left] < end[left]]
            some = some[at[some] < end[some]]
        out[k[some], c[some]] = sums[at[some]]
        return out

    def prepare(self) -> None:
        """Finds the words of all runs until each has one that is not busy, or all of those that cost no more than its cover by shorter runs.

        Limits rise for all runs together; what is found bounds the runs that hold it.
        """
        if not self.most:
            return
        each, n = self.p["WORD_NUMBER_PENALTY"], self.number.shape[1]
        # where words may not repeat, a cover's own words make runs dearer than their first words tell
        spare = 0.0 if self.p["DUPLICATE"] else SPARE
        there = self.number >= 0
        now = COVER_LIMIT
        while True:
            best = self.free()
            covers, tops = np.full((self.most, n), np.inf), np.full((self.most, n), np.inf)
            tops[0] = FILLER + each
            for k in range(self.most):
                for m in range(k):
                    tops[k, : n - m - 1] = np.minimum(tops[k, : n - m - 1], covers[m, : n - m - 1] + covers[k - m - 1, m + 1 :])
                covers[k] = np.where(there[k], np.minimum(tops[k], best[k] + self.add[k]), np.inf)
            need = np.where(there, np.minimum(tops - np.where(there, self.add, 0.0) + spare * self.scale, self.top), -np.inf)
            done = np.where(there, self.done[self.number], np.inf)
            short = ~np.isfinite(best) & (done + EPS < need)
            if not short.any():
                return
            # edits have no weight
            limit = np.minimum(np.where(self.scale == 1.0, now, now * self.scale + (now - COVER_LIMIT) / 4), need)
            wanted = np.where(short & (done + EPS < limit), limit, -np.inf)
            if np.isfinite(wanted).any():
                self.find(wanted)
            now = further(now, COVER_STEP)

    def opened(self) -> None:
        """What is found so far, as Python's own numbers."""
        self.begin = np.searchsorted(self.kept[0], np.arange(len(self.done) + 1)).tolist()
        _, row, sums, word = self.kept
        self.listed = sums.tolist(), word.tolist(), row.tolist()
        self.known = self.done.tolist()
        self.stale = False

    def cover_line(self, x: int, missing: dict[tuple[int, int], float]) -> list[list[tuple]]:
        """The covers of a line's free stretches; where more words of a run must be known, it and their limit go to missing."""
        line = self.lines[x]
        busy = None if self.busy[x] is None else set(self.busy[x])
        out = []
        for s, t in line.free:
            out.append(self._stretch(x, line, busy, s, t, missing))
            if missing:
                break
            if busy is not None:
                busy |= {w[2] for w in out[-1] if w[2] is not None}
        return out

    def _stretch(self, x: int, line: Line, busy: set[int] | None, s: int, t: int, missing: dict[tuple[int, int], float]) -> list[tuple]:
        """The cover of syllables s to t, as Covers.cover tells it."""
        a, each, n = int(self.first[x]), self.p["WORD_NUMBER_PENALTY"], len(line.numbers)
        sums, words, rows = self.listed
        begin, known = self.begin, self.known
        numbers = self.number[:, a + s : a + t].T.tolist()
        ending = self.ending[a + s : a + t].tolist() if self.most else [0] * (t - s)
        best: list[tuple[float, tuple | None, frozenset]] = [(0.0, None, frozenset())]
        for e in range(s + 1, t + 1):
            base = best[e - 1 - s][0]
            chosen = (base + FILLER + each, 2 * (e - 1))
            step = (e - 1, e, None, None, FILLER, FILLER)
            add = self.adjusted(line.breaks, n, e)
            left = []
            for i in range(e - 1, e - 1 - ending[e - 1 - s], -1):
                base, _, own = best[i - s]
                slack = chosen[0] - base - each - add
                run = numbers[i - s][e - i - 1]
                for j in range(begin[run], begin[run + 1]):
                    if sums[j] > slack + EPS:
                        break
                    if busy is None or (words[j] not in busy and words[j] not in own):
                        sim = sums[j]
                        score = sim - self.p["SAME_PHRASE_BREAK_REWARD"] if e in line.breaks else sim + (self.p["MID_PHRASE_BREAK_PENALTY"] if e != n else 0.0)
                        now = (base + score + each, 2 * i + 1)
                        if now < chosen:
                            chosen, step = now, (i, e, words[j], rows[j], sim, score)
                        break
                else:
                    if known[run] + EPS < slack and known[run] + EPS < self.top[e - i - 1, a + i]:
                        left.append((i, base, run))
            for i, base, run in left:
                need = min(chosen[0] - base - each - add, float(self.top[e - i - 1, a + i]))
                if known[run] + EPS < need:
                    scale = max(0.1, float(self.scale[e - i - 1, a + i])) if self.weighted else 1.0
                    missing[e - i - 1, a + i] = min(need, max(scale * COVER_LIMIT, further(known[run], 4 * scale * COVER_STEP)))
            own = best[step[0] - s][2]
            best.append((chosen[0], step, own | {step[2]} if busy is not None and step[2] is not None else own))
        out = []
        at = t
        while at > s:
            step = best[at - s][1]
            out.append(step)
            at = step[0]
        return out[::-1]

    def covers(self) -> list[list[list[tuple]]]:
        """The covers of every line's free stretches. Runs whose known words are all used are taken up again, those of all lines together."""
        self.prepare()
        return self.taken(range(len(self.lines)))

    def taken(self, some) -> list[list[list[tuple]]]:
        """The covers of some lines, by what is found and the words that are busy now."""
        out: dict[int, list] = {}
        open_ = some = list(some)
        while open_:
            if self.stale:
                self.opened()
            wanted = np.full(self.number.shape, -np.inf)
            left = []
            for x in open_:
                missing: dict[tuple[int, int], float] = {}
                out[x] = self.cover_line(x, missing)
                if missing:
                    left.append(x)
                    for at, limit in missing.items():
                        wanted[at] = limit
            open_ = left
            if left:
                self.find(wanted)
        return [out[x] for x in some]


def covered(words: Words, parameters: dict, songs: list[tuple[list, set | None]]) -> list[tuple]:
    """Result rows of songs, given as lines in order and used words, which grow, or None where words may repeat.

    Where no word may come twice, the first lines of all songs are covered together, then the second
    ones, and so on. Runs of all these lines are walked together before: what is found for a run
    holds for every line, whichever words are busy by then.
    """
    ways = Ways(words.place)
    out: list[list[tuple]] = [[] for _ in songs]
    repeats = bool(songs) and songs[0][1] is None
    # (step, song, line), by step: lines of one step do not depend on each other
    asked = sorted(((0 if repeats else k, x, r) for x, (rows, _) in enumerate(songs) for k, r in enumerate(rows)), key=lambda e: e[0])
    # lines with weights share little
    weighted = any(_listed(r.weights) for _, _, r in asked)
    size = np.cumsum([0, *(len(_listed(r.units)) for _, _, r in asked)]) // (UNITS // 4 if weighted else UNITS)
    for _, some in groupby(range(len(asked)), lambda k: size[k]):
        part = [asked[k] for k in some]
        batch = Batch(words, parameters, ways, [_line(ways, r) for _, _, r in part], [songs[x][1] for _, x, _ in part])
        batch.prepare()
        for _, step in groupby(range(len(part)), lambda k: part[k][0]):  # noqa: B023
            step = list(step)
            for k in step:
                if (busy := batch.busy[k]) is not None:
                    busy.update(n for lock in batch.lines[k].locks if (n := words.numbered(lock["id"])) is not None)
            for k, paths in zip(step, batch.taken(step)):
                path = iter(paths)
                out[part[k][1]] += _rows(words, batch.lines[k], batch.busy[k], lambda s, t: next(path))  # noqa: B023
    return [r for rows in out for r in rows]


def covered_songs(words: Words, parameters: dict, rows, busy: set | None) -> list[tuple]:
    """Result rows of one song's lines in order; busy: its used words, which grow, or None where words may repeat."""
    return covered(words, parameters, [(list(rows), busy)])


class Candidates:
    """Ranked words of a song's runs, k of each at most, in place of an index at hand."""

    def __init__(self, names: list[str], longest: int):
        self.names, self.place, self.longest = names, {u: i for i, u in enumerate(names)}, longest

    def numbered(self, id_: str | None) -> str | None:
        return id_

    def told(self, row) -> dict:
        return row


class Short(Exception):
    """A run's candidates are all used, and there may be more."""


class Listed(Covers):
    """Covers by ranked candidates, as many as k for a run."""

    def __init__(self, words: Candidates, parameters: dict, k: int):
        self.words, self.p, self.k, self.ways, self.longest = words, parameters, k, Ways(words.place), words.longest
        self.spans: dict[tuple[int, int], list] = {}

    def first_free(self, line, weights, i: int, e: int, top: float, busy: set | None, own: frozenset):
        found = self.spans.get((i, e), [])
        for f in found:
            if f["sim"] > top + EPS:
                return None
            if busy is None or (f["id"] not in busy and f["id"] not in own):
                return f["sim"], f["id"], f
        if len(found) >= self.k and busy is not None:
            raise Short
        return None


#: Candidates of a run that are asked for first where no word may come twice; eight times as many for songs that use them up.
FIRST_CANDIDATES = 8


def _generate_by_shards(rows: DataFrame, found: Index, p: dict) -> DataFrame:
    """generate over an index that is not broadcast: candidates of all different runs, then the covers."""
    rows = stored(rows)
    longest = int(found.words.agg(F.max("n_units")).first()[0] or 0)
    least = F.transform("ways", lambda w: F.coalesce(F.array_min(F.transform(w["v"], lambda v: F.size(v["units"]))), F.lit(0)))
    before = F.aggregate(least, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + k)))
    ends = rows.select("song", "line", "ways", "weights", before.alias("before")).select("*", F.explode(F.when(F.size("ways") > 0, F.sequence(F.lit(1), F.size("ways")))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.get("before", F.col("t")) - F.get("before", i) <= longest)
    some = lambda c: F.slice(c, F.col("i") + 1, F.col("t") - F.col("i"))
    runs = ends.select("song", "line", "ways", "weights", "t", F.explode(starts).alias("i")).select("song", "line", "i", "t", some("ways").alias("ways"), some("weights").alias("w"))
    name = F.concat_ws("\0", F.transform("ways", lambda w: w["s"]), F.coalesce(F.transform("w", lambda x: x.cast("string")), F.array().cast("array<string>")))
    runs = stored(runs.withColumn("target", name))
    each = runs.groupBy("target").agg(F.first("ways").alias("ways"), F.first("w").alias("w"))
    details = found.words.groupBy("id", "n_units", "seq").agg(*(F.first(c).alias(c) for c in ("codes", "vcost", "surface", "original", "kana")))
    names = found.names

    def asked(songs: DataFrame | None, k: int) -> DataFrame:
        mine = runs if songs is None else runs.join(songs, "song", "left_semi")
        targets = each if songs is None else each.join(mine.select("target").distinct(), "target", "left_semi")
        cands = _nearest_by_shards(targets, found, k).join(details, ["id", "n_units", "seq"])
        lists = cands.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "sim", "id", "codes", "vcost", "surface", "original", "kana"))).alias("c"))
        spans = mine.select("song", "line", "i", "t", "target").join(lists, "target").groupBy("song", "line").agg(F.collect_list(F.struct("i", "t", "c")).alias("spans"))
        part = rows if songs is None else rows.join(songs, "song", "left_semi")
        return part.join(spans, ["song", "line"], "left")

    def made(pdf: pd.DataFrame, k: int, busy: set | None) -> list[tuple]:
        covers = Listed(Candidates(names, longest), p, k)
        out = []
        for r in pdf.itertuples():
            covers.spans = {(x["i"], x["t"]): list(x["c"]) for x in _listed(r.spans)}
            line = _line(covers.ways, r)
            out += _rows(covers.words, line, busy, lambda s, t: covers.cover(line.numbers, line.weights, line.breaks, busy, s, t))  # noqa: B023
        return out

    if p["DUPLICATE"]:

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame(made(pdf, 1, None), columns=COLUMNS)

        return asked(None, 1).mapInPandas(alone, GENERATED)

    def song(k: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            try:
                return pd.DataFrame(made(pdf.sort_values("line", kind="stable"), k, set()), columns=COLUMNS).assign(short=False)
            except Short:
                return pd.DataFrame([(pdf["song"].iloc[0], *[None] * (len(COLUMNS) - 1), True)], columns=[*COLUMNS, "short"])

        return run

    out, songs, k = None, None, FIRST_CANDIDATES
    while True:
        now = stored(asked(songs, k).groupBy("song").applyInPandas(song(k), GENERATED + ", short boolean"))
        whole = now.where("NOT short").drop("short")
        out = whole if out is None else out.unionByName(whole)
        songs = now.where("short").select("song").distinct()
        if songs.isEmpty():
            return out
        k *= 8


def generate(lines: DataFrame, words: DataFrame | Index, dist: DataFrame | None = None, parameters: dict | None = None) -> DataFrame:
    """Words for every line of every song, as GENERATED rows; with DUPLICATE off no word comes twice in a song.

    lines(song, line, units[, breaks, weights, surfaces, locks]): units are syllables; weights,
    one for each syllable, count distances by position and are ignored where they are not valid;
    locks, array<struct<i, t, id, sim[, surface, pronunciation, kana, original]>>, pin words and
    are told with what they bring, else with the line's own units; a lock without id is a filler. words: the word
    table or its index. Without DUPLICATE a song is one group, since each line depends on the
    words before it; else lines are apart. Lines without units give no rows. An index that is
    too large to be broadcast is asked for the ranked words of all different runs instead.
    """
    p = DEFAULTS | (parameters or {})
    found = words if isinstance(words, Index) else index(words, dist, p["VARIATION_COST"])
    rows = line_rows(lines)
    if not found.fits():
        return _generate_by_shards(rows, found, p)
    shared = found.shared()
    # few tasks: the more lines a task has, the more their walks share
    n = max(1, min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * lines.sparkSession.sparkContext.defaultParallelism))

    def told(lines: list, again: bool) -> pd.DataFrame:
        songs = [lines] if again else [list(some) for _, some in groupby(lines, lambda r: r.song)]
        return pd.DataFrame(covered(held(shared), p, [(some, None if again else set()) for some in songs]), columns=COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list = []
        size = 0
        for pdf in batches:
            for r in pdf.itertuples():
                # a song stays whole where no word may come twice
                if size > UNITS and (p["DUPLICATE"] or r.song != waiting[-1].song):
                    yield told(waiting, p["DUPLICATE"])
                    waiting, size = [], 0
                waiting.append(r)
                size += len(_listed(r.units))
        if waiting:
            yield told(waiting, p["DUPLICATE"])

    if p["DUPLICATE"]:
        return rows.repartition(n, "song", "line").mapInPandas(run, GENERATED)
    return rows.repartition(n, "song").sortWithinPartitions("song", "line").mapInPandas(run, GENERATED)
