"""The sharded index and its walks against plain search."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hibiki.functions import kana
from hibiki.operators import distance, lattice, segment

UNITS = ["カ", "キ", "コ", "サ", "ン", "ッ", "カー", "ト", "ナ"]
SAID = ["カ", "キ", "コ", "サン", "カッ", "トー", "ン", "ナイ", "x"]


def word_table(spark, rng, n, ids=40):
    rows = []
    for seq in range(n):
        units = [rng.choice(UNITS) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5]))]
        wid = str(rng.randrange(ids)) if rng.random() < 0.5 else f"w{rng.randrange(ids)}"
        rows.append((wid, len(units), seq, units, rng.randrange(3), f"s{wid}", f"k{seq}"))
    rows.append(("odd", 2, n, ["カ", "?"], 0, "odd", "odd"))
    return rows, spark.createDataFrame(rows, "id string, n_units int, seq long, units array<string>, vcost int, surface string, kana string")


@pytest.fixture(scope="module")
def dist(spark):
    """A small matrix with sums that are not binary fractions."""
    rng = random.Random(3)
    rows = [(a, b, 0.0 if a == b else round(rng.uniform(1, 30), 1)) for a, b in itertools.product(UNITS, UNITS)]
    return spark.createDataFrame(rows, "u1 string, u2 string, dist double")


def syllables_of(spark, lists):
    """Ways of each list of syllables: (units, edits, syllable of each unit)."""
    df = spark.createDataFrame(list(enumerate(lists)), "i int, s array<string>")
    return {r.i: [(v["units"], v["vcost"], v["src"]) for v in r.v] for r in df.select("i", kana.variations(F.col("s")).alias("v")).collect()}


def plain_ranked(ways, rows, d, cost, weights=None):
    """All ids with their best sums, as the joins and the order of ids rank them."""
    found = {}
    for wid, n, seq, units, vcost, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        sums = []
        for u, edits, src in ways:
            if len(u) == n and all((a, b) in d for a, b in zip(u, units)):
                total = 0.0
                for k, (a, b) in enumerate(zip(u, units)):
                    total += d[a, b] * (weights[src[k]] if weights else 1.0)
                sums.append(total + (edits + vcost) * cost)
        if sums:
            seen = found[wid][3] if wid in found else (n, seq)
            if wid not in found or min(sums) <= found[wid][0]:
                found[wid] = (min(sums), n, seq, seen)
    key = lambda w: (found[w][0], not w.isdigit(), int(w) if w.isdigit() else 0, *found[w][3])
    return [(w, *found[w][:3]) for w in sorted(found, key=key)]


@pytest.mark.parametrize("far, shard", [(False, None), (False, 7), (True, 7), (True, 1_000)])
def test_ranks_over_shards(spark, dist, monkeypatch, far, shard):
    if far:
        monkeypatch.setattr(lattice, "BROADCAST_BYTES", 0)
    rng = random.Random(5)
    rows, words = word_table(spark, rng, 120)
    d = {(r.u1, r.u2): r.dist for r in dist.collect()}
    lists = [[rng.choice(SAID[:-1]) for _ in range(rng.randrange(1, 5))] for _ in range(25)] + [[], ["x"], ["カ", "x"], ["ン", "ン"]]
    ways = syllables_of(spark, lists)
    found = lattice.index(words, dist, 2.5, shard)
    assert found.count > 5 or shard != 7
    weights = [[rng.uniform(0, 3) for _ in s] if rng.random() < 0.7 else None for s in lists]
    targets = spark.createDataFrame([(f"t{i}", s, w) for i, (s, w) in enumerate(zip(lists, weights))], "target string, syllables array<string>, w array<double>")
    for k, weighted in ((3, False), (None, False), (4, True)):
        got = {}
        for r in lattice.nearest(targets, found, k=k, weights=F.col("w") if weighted else None).collect():
            got.setdefault(r.target, []).append((r["rank"], r.id, r.sim, r.n_units, r.seq))
        for i, s in enumerate(lists):
            w = weights[i] if weighted else None
            w = [x * len(w) / sum(w) for x in w] if w and sum(w) > 0 else None
            want = plain_ranked(ways[i], rows, d, 2.5, w)[: k or 10_000]
            mine = sorted(got.get(f"t{i}", []))
            assert [x[0] for x in mine] == list(range(1, len(want) + 1))
            assert [(x[1], pytest.approx(x[2]), x[3], x[4]) for x in mine] == [tuple(x) for x in want]


def plain_cover(n, breaks, ranked, used, p, s, t):
    return segment.best_path(n, breaks, ranked, used, p, s, t)[1]


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize("again", [False, True])
def test_songs_against_plain_search(spark, dist, monkeypatch, far, again):
    """Whole songs with breaks, weights and locks against a search that ranks all words of every run."""
    if far:
        monkeypatch.setattr(lattice, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(lattice, "FIRST_CANDIDATES", 2)
    rng = random.Random(7)
    rows, words = word_table(spark, rng, 90, 12)
    d = {(r.u1, r.u2): r.dist for r in dist.collect()}
    p = segment.DEFAULTS | {"DUPLICATE": again, "MID_PHRASE_BREAK_PENALTY": 3.0, "SAME_PHRASE_BREAK_REWARD": 2.0, "VARIATION_COST": 2.5, "WORD_NUMBER_PENALTY": 1.5}
    lines = []
    for song in range(4):
        for line in range(4):
            units = [rng.choice(SAID) for _ in range(rng.choice([0, 3, 6, 9]))]
            n = len(units)
            weights = [rng.uniform(0.1, 3) for _ in units] if line % 2 else None
            locks = [(1, 2, "3", 0.5, "ソラミミ", ["ソ", "ラ"], "ソラ", "空"), (4, 5, None, 1e6, None, None, None, None)] if line == 2 and n >= 6 else None
            lines.append((song, line, units, sorted({0, *rng.sample(range(max(1, n)), min(n, 2))}), weights, [f"{u}'" for u in units], locks))
    df = spark.createDataFrame(lines, f"song long, line long, units array<string>, breaks array<int>, weights array<double>, surfaces array<string>, locks array<{lattice.LOCK}>")
    made = lattice.generate(df, words, dist, p).collect()
    spans = {}
    for x, (_, _, units, _, weights, _, _) in enumerate(lines):
        for i, t in itertools.combinations(range(len(units) + 1), 2):
            spans[x, i, t] = units[i:t]
    ways = dict(zip(spans, syllables_of(spark, spans.values()).values()))
    want = []
    used = {}
    for x, (song, line, units, breaks, weights, surfaces, locks) in enumerate(lines):
        w = [y * len(units) / sum(weights) for y in weights] if weights else None
        ranked = {(i, t): [(r[1], r[0]) for r in plain_ranked(ways[y, i, t], rows, d, 2.5, w[i:t] if w else None)] for y, i, t in spans if y == x}
        busy = used.setdefault(song, set()) if not again else set()
        busy |= {k[2] for k in locks or [] if k[2]}
        at, k = 0, 0
        for lock in [*(locks or []), None]:
            end = len(units) if lock is None else lock[0]
            if at < end:
                path = plain_cover(len(units), set(breaks), ranked, busy, p, at, end)
                want += [(song, line, k + j, w_["i"], w_["t"], w_["id"], w_["id"] is None, False) for j, w_ in enumerate(path)]
                k += len(path)
                busy |= {w_["id"] for w_ in path if w_["id"]}
            if lock is not None:
                want.append((song, line, k, lock[0], lock[1], lock[2], lock[2] is None, True))
                k, at = k + 1, max(at, lock[1])
    got = [(r.song, r.line, r.word, r.i, r.t, r.id, r.filler, r.locked) for r in made]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    pinned = [r for r in made if r.locked and r.id == "3"]
    assert pinned and all((r.surface, r.pronunciation, r.kana, r.original, r.sim) == ("ソラミミ", ["ソ", "ラ"], "ソラ", "空", 0.5) for r in pinned)
    assert all(r.originalkana == "".join(lines[r.song * 4 + r.line][2][r.i : r.t]) and r.original_surface == "".join(f"{u}'" for u in lines[r.song * 4 + r.line][2][r.i : r.t]) for r in made)
    fillers = [r for r in made if r.filler]
    assert all(r.surface == r.originalkana and r.pronunciation == lines[r.song * 4 + r.line][2][r.i : r.t] for r in fillers if not r.locked)


def test_empty_lists(spark, dist):
    none = spark.createDataFrame([], "id string, n_units int, seq long, units array<string>, vcost int")
    lines = spark.createDataFrame([(1, 0, ["カ", "キ"])], "song long, line long, units array<string>")
    targets = spark.createDataFrame([("a", ["カ"])], "target string, syllables array<string>")
    assert lattice.nearest(targets, none, dist, k=3).collect() == []
    for again in (True, False):
        assert [r.filler for r in lattice.generate(lines, none, dist, {"DUPLICATE": again}).collect()] == [True, True]


def test_a_walk_leaves_most_nodes_out(spark, dist):
    """The limit and the lengths that are asked for keep a walk from nearly all pairs of nodes."""
    rng = random.Random(1)
    _, words = word_table(spark, rng, 3_000, 900)
    own = lattice.held(lattice.index(words, dist, 2.5).shared())
    ways = [{"s": u, "v": [{"units": [u], "cost": 0}]} for u in UNITS]
    targets = [([rng.choice(ways) for _ in range(5)], None) for _ in range(100)]
    assert all(lattice.ranks(own, targets, 1))
    assert own.visited < 0.1 * own.possible


def lines_of(rng, n, size, units=tuple(UNITS)):
    """n lines of words' units, as line_rows tells them."""
    from types import SimpleNamespace as Row

    way = lambda u: {"s": u, "v": [{"units": [u], "cost": 0}]}
    said = [[rng.choice(units) for _ in range(size)] for _ in range(n)]
    return [Row(song=x // 5, line=x % 5, units=s, ways=[way(u) for u in s], weights=None, breaks=[], surfaces=None, locks=None) for x, s in enumerate(said)]


def test_lines_share_their_walks(spark, dist, monkeypatch):
    """The runs of many lines are walked together, in few walks: two for 2,048 starts and a limit."""
    rng = random.Random(1)
    _, words = word_table(spark, rng, 500, 100)
    own = lattice.held(lattice.index(words, dist, 2.5).shared())
    walks = []
    walk = type(own).walk
    monkeypatch.setattr(type(own), "walk", lambda *a: walks.append(1) or walk(*a))
    made = lattice.covered_songs(own, segment.DEFAULTS | {"VARIATION_COST": 2.5}, lines_of(rng, 200, 20), None)
    assert sum(r[4] - r[3] for r in made) == 200 * 20 and len(walks) <= 12


def test_songs_share_their_walks(spark, dist, monkeypatch):
    """The n-th lines of all songs are covered together: walks do not grow in number with the songs, and each song's words are those that it has alone."""
    rng = random.Random(2)
    _, words = word_table(spark, rng, 500, 100)
    own = lattice.held(lattice.index(words, dist, 2.5).shared())
    lines = lines_of(rng, 100, 8)
    songs = [[r for r in lines if r.song == s] for s in range(20)]
    p = segment.DEFAULTS | {"VARIATION_COST": 2.5, "DUPLICATE": False}
    walks = []
    walk = type(own).walk
    monkeypatch.setattr(type(own), "walk", lambda *a: walks.append(1) or walk(*a))
    alone = [r for s in songs for r in lattice.covered_songs(own, p, s, set())]
    n = len(walks)
    walks.clear()
    assert lattice.covered(own, p, [(s, set()) for s in songs]) == alone
    assert len(walks) < n / 4


def test_sums_of_rows(spark, dist):
    """What a row costs for a sequence, told by itself, is what a walk tells."""
    import numpy as np

    rng = random.Random(4)
    _, words = word_table(spark, rng, 200)
    own = lattice.held(lattice.index(words, dist, 2.5).shared())
    lists = [[rng.choice(SAID[:-1]) for _ in range(rng.randrange(1, 5))] for _ in range(20)]
    ways = lattice.Ways(own.place)
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, s array<string>").sort("i").select(lattice._variants(F.col("s")).alias("w")).collect()
    numbers = [lattice._number(ways, r.w) for r in rows]
    syllables = lattice._padded(numbers, -1)
    weights = np.array([[rng.uniform(0, 3) for _ in s] for s in syllables])
    own.both()
    for w in (None, weights):
        asked = lattice.Asked(syllables, w)
        ends = np.array([asked.node[x, len(n) - 1] for x, n in enumerate(numbers)])
        limit = np.full(asked.size, -np.inf)
        limit[ends] = 1e4
        seen = 0
        for nodes, found, sums in own.walk(ways, asked, limit):
            x = np.array([int(np.flatnonzero(ends == n)[0]) for n in nodes], np.int64)
            least = {}
            for k, r, s in zip(x, found, sums):
                least[k, r] = min(s, least.get((k, r), np.inf))
            at = np.array(list(least)).reshape(-1, 2)
            got = own.sums(ways, syllables[at[:, 0]], None if w is None else w[at[:, 0]], at[:, 1])
            assert got.tolist() == pytest.approx(list(least.values()))
            seen += len(at)
        assert seen > 100
