"""The word list as prefix trees in arrays, and walks of many unit sequences against them at once.

A tree holds word rows in order of their units. Its nodes are numbered level by level, so that
the children of a node lie side by side. Asked sequences are syllables, each with several ways
to say it; sequences that begin alike share the nodes of a second tree. A walk moves pairs of a
node of either tree forward, one syllable of the asked sequences at a time, for all of them
together, and drops a pair as soon as its cost plus the least that its syllables can still cost
passes the limit of every sequence through it. What is found is all word rows within the limit, so a limit can be
raised where too little was found, and nothing within it is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slack of a limit, for sums that differ in the last digits.
EPS = 1e-6
#: Asked sequences that are walked together.
GROUP = 256


def _runs(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c, one behind the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


#: Bits of a set of lengths; the last one stands for LAST and more.
LAST = 62


def _further(bits: np.ndarray, k) -> np.ndarray:
    """Lengths k longer."""
    return ((bits << k) & ((1 << LAST + 1) - 1)) | np.where(bits >> (LAST - k), 1 << LAST, 0)


class Tree:
    """codes: the word rows' units one behind the other, sizes: how many each row has; rows in order of their units."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        first = np.cumsum(sizes) - sizes
        most = int(sizes.max(initial=0))
        at = np.zeros(n, np.int64)  # each row's node at the present depth
        code, parent = [np.zeros(1, np.int32)], [np.zeros(1, np.int64)]
        made = 1
        ends = np.zeros(n, np.int64)
        alive = np.arange(n)
        for d in range(most):
            alive = alive[sizes[alive] > d]
            c, p = codes[first[alive] + d], at[alive]
            new = np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])]
            at[alive] = made + np.cumsum(new) - 1
            code.append(c[new].astype(np.int32))
            parent.append(p[new])
            made += int(new.sum())
            ends[alive] = at[alive]
        self.code, parent = np.concatenate(code), np.concatenate(parent)
        self.size = made
        self.kids = np.bincount(parent[1:], minlength=made)
        self.kid = np.searchsorted(parent[1:], np.arange(made)) + 1  # parents rise with their children
        order = np.argsort(ends, kind="stable")
        self.row = order
        self.rows = np.bincount(ends, minlength=made)
        self.rows[0] = 0
        self.first_row = np.searchsorted(ends[order], np.arange(made))
        #: Bit k: a row ends k units below the node; the last bit stands for all further ones.
        self.below = (self.rows > 0).astype(np.int64)
        level = np.cumsum([0, *map(len, code)])
        for d in range(len(code) - 1, 0, -1):
            a, b = level[d], level[d + 1]
            np.bitwise_or.at(self.below, parent[a:b], _further(self.below[a:b], 1))
        #: Units of the longest way down to a row.
        self.deep = np.zeros(made, np.int64)
        for d in range(len(code) - 1, 0, -1):
            a, b = level[d], level[d + 1]
            np.maximum.at(self.deep, parent[a:b], self.deep[a:b] + 1)


class Ways:
    """All syllables that are asked for, by number: their ways as unit codes and edits."""

    def __init__(self, place: dict[str, int]):
        self.place, self.number, self.list = place, {}, []
        self.made = -1

    def add(self, syllable: str, ways: list[tuple[list[str], int]]) -> int:
        k = self.number.get(syllable)
        if k is None:
            k = self.number[syllable] = len(self.list)
            coded = [([self.place.get(u, -1) for u in units], edits) for units, edits in ways]
            self.list.append([(units, edits) for units, edits in coded if -1 not in units])
        return k

    def turned(self) -> Ways:
        """The same syllables said backwards, under the same numbers."""
        out = Ways(self.place)
        out.list = [[(units[::-1], edits) for units, edits in ways] for ways in self.list]
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.made != len(self.list):
            self.kept, self.made = self._arrays(), len(self.list)
        return self.kept

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each syllable and slot: units (3), their number or -1 where there is no such way, and edits; and each syllable's lengths as bits."""
        slots = max((len(w) for w in self.list), default=1) or 1
        units = np.zeros((len(self.list), slots, 3), np.int64)
        count = np.full((len(self.list), slots), -1, np.int64)
        edits = np.zeros((len(self.list), slots), np.int64)
        lengths = np.zeros((len(self.list), 4), bool)
        for k, ways in enumerate(self.list):
            for s, (u, e) in enumerate(ways):
                units[k, s, : len(u)], count[k, s], edits[k, s] = u, len(u), e
                lengths[k, len(u)] = True
        return units, count, edits, lengths


class Asked:
    """A tree of asked sequences: rows of syllable numbers, -1 behind their end, with a weight for each where given.

    node[i, j]: the node of the first j + 1 syllables of sequence i, nodes numbered level by level, -1 behind the end.
    """

    def __init__(self, syllables: np.ndarray, weights: np.ndarray | None = None):
        n, most = syllables.shape
        self.node = np.full((n, most), -1, np.int64)
        self.level, made, before = [], 0, np.zeros(n, np.int64)
        for j in range(most):
            there = np.flatnonzero(syllables[:, j] >= 0)
            keys = [before[there], syllables[there, j]] + ([] if weights is None else [weights[there, j]])
            order = np.lexsort(keys[::-1])  # by parent first: children lie side by side
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            first = order[new]
            self.node[there[order], j] = made + np.cumsum(new) - 1
            i = there[first]
            self.level.append((np.where(j > 0, self.node[i, j - 1], 0), syllables[i, j], np.ones(len(i)) if weights is None else weights[i, j]))
            made += len(first)
            before[there] = self.node[there, j]
        self.size = made


class Words:
    """The word rows of all shards, their trees, and what the order of results needs."""

    def __init__(self, blobs: list[bytes], names: list[str], grid: np.ndarray, variation_cost: float):
        self.names, self.place = names, {u: i for i, u in enumerate(names)}
        self.grid, self.cost = grid, float(variation_cost)
        self.flat = np.ascontiguousarray(grid).reshape(-1)
        self.visited = self.possible = 0
        tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
        self.trees, self.base = [], []
        n = 0
        for t in tables:
            units = t["codes"].combine_chunks()
            self.trees.append(Tree(pc.list_flatten(units).to_numpy(), pc.list_value_length(units).to_numpy()))
            self.base.append(n)
            n += len(t)
        self.table = pa.concat_tables(tables).combine_chunks() if tables else None
        self.n_units = np.zeros(0, np.int64)
        if not tables:
            return
        read = lambda c: self.table[c].to_numpy()
        self.n_units, self.seq, self.vcost = read("n_units").astype(np.int64), read("seq"), read("vcost").astype(np.int64)
        ids = pc.dictionary_encode(self.table["id"]).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.ids, self.word = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
        self.number_of = None
        self.sides = self.dear = None
        self.telling: dict[int, dict] = {}
        # ids that are integers come first, by number; others as first seen
        digits = pc.match_substring_regex(self.ids, "^(0|[1-9][0-9]{0,9})$")
        number = pc.if_else(digits, self.ids, "0").cast(pa.int64()).to_numpy()
        self.whole = digits.to_numpy(zero_copy_only=False) & (number < 4294967295)
        self.number = np.where(self.whole, number, 0)
        order = np.lexsort((self.seq, self.n_units, self.word))
        w, k = self.word[order], self.n_units[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]
        #: Each id's first place for each number of units.
        self.seen_word, self.seen_n, self.seen_seq = w[new], k[new], self.seq[order][new]
        self.seen_at = np.searchsorted(self.seen_word, np.arange(len(self.ids) + 1))
        #: The largest sum that any word can have with weights of 1.
        self.most = float(grid[np.isfinite(grid)].max(initial=0.0)) * int(self.n_units.max()) + self.cost * (int(self.vcost.max()) + 4 * int(self.n_units.max()) + 64)

    def dearest(self) -> np.ndarray:
        """By unit: the most that it costs against any unit of a word."""
        if self.dear is None:
            codes = np.unique(pc.list_flatten(self.table["codes"]).to_numpy())
            own = self.grid[:, codes]
            self.dear = np.where(np.isfinite(own), own, 0.0).max(axis=1, initial=0.0)
        return self.dear

    def numbered(self, id_: str | None) -> int | None:
        """The number of an id."""
        if self.number_of is None:
            self.number_of = {x: i for i, x in enumerate(self.ids.to_pylist())} if len(self.n_units) else {}
        return self.number_of.get(id_)

    def told(self, row: int) -> dict:
        """What a word row says."""
        out = self.telling.get(row)
        if out is None:
            out = {c: self.table[c][row].as_py() for c in ("id", "codes", "surface", "original", "kana")} | {"vcost": int(self.vcost[row])}
            if len(self.telling) < 1 << 17:
                self.telling[row] = out
        return out

    def both(self) -> tuple[list[tuple[Tree, np.ndarray]], list[tuple[Tree, np.ndarray]]]:
        """One tree of all rows, and one of all rows said backwards; each with its rows' numbers."""
        if self.sides is None:
            codes, sizes = pc.list_flatten(self.table["codes"]).to_numpy(), self.n_units
            self.exact = not (self.grid[np.isfinite(self.grid)] % 1).any() and self.cost % 1 == 0
            #: each row's units, -1 behind their end
            self.units = np.full((len(sizes), int(sizes.max())), -1, np.int64)
            row, place = np.repeat(np.arange(len(sizes)), sizes), _runs(sizes)
            self.units[row, place] = codes
            back = np.full_like(self.units, -1)
            back[row, sizes[row] - 1 - place] = codes
            made = []
            for units in (self.units, back):
                order = np.lexsort(units.T[::-1])
                some = units[order]
                made.append([(Tree(some[some >= 0], sizes[order]), order)])
            self.sides = tuple(made)
        return self.sides

    def sums(self, ways: Ways, syllables: np.ndarray, weights: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
        """What each row costs for its sequence of syllables, summed as a walk sums: unit by unit from the first."""
        units, count, edits, _ = ways.arrays()
        word = self.units[rows]
        total = np.full((len(rows), word.shape[1] + 1), np.inf)
        spent = np.zeros(total.shape, np.int64)
        total[:, 0] = 0.0
        for j in range(syllables.shape[1]):
            to, used = np.full_like(total, np.inf), np.zeros_like(spent)
            s = syllables[:, j]
            to[s < 0], used[s < 0] = total[s < 0], spent[s < 0]
            for slot in range(count.shape[1]):
                n = np.where(s >= 0, count[s, slot], -1)
                for k in range(4):
                    x = np.flatnonzero(n == k)
                    if not len(x) or k >= total.shape[1]:
                        continue
                    now, e = total[x, : total.shape[1] - k], spent[x, : total.shape[1] - k] + edits[s[x], slot][:, None]
                    for p in range(k):
                        code = word[x, p : p + now.shape[1]]
                        step = self.grid[units[s[x], slot, p][:, None], code]
                        now = now + np.where(code >= 0, step if weights is None else step * weights[x, j][:, None], np.inf)
                    old, had = to[x, k:], used[x, k:]
                    less = now + e * self.cost < old + had * self.cost
                    to[x, k:], used[x, k:] = np.where(less, now, old), np.where(less, e, had)
            total, spent = to, used
        n = self.n_units[rows]
        at = np.arange(len(rows))
        return total[at, n] + (spent[at, n] + self.vcost[rows]) * self.cost

    def seen(self, word: int, lengths: int) -> tuple[int, int]:
        """The first place of an id among words of the given lengths, which are bits."""
        for k in range(self.seen_at[word], self.seen_at[word + 1]):
            if lengths >> int(self.seen_n[k]) & 1:
                return int(self.seen_n[k]), int(self.seen_seq[k])
        return (1 << 62, 0)

    def key(self, word: int, lengths: int) -> tuple:
        if self.whole[word]:
            return (False, int(self.number[word]), 0)
        return (True, *self.seen(word, lengths))

    def walk(self, ways: Ways, asked: Asked, limit: np.ndarray, within: np.ndarray | None = None, trees: list[tuple[Tree, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(asked nodes, rows, sums) of all word rows within limit[node], in any order; one row may come several times for a node.

        within[node, m]: what a pair may have cost at each asked node if no more than m units follow,
        the last m for all further ones; else the largest limit below it. trees: with their rows'
        numbers, in place of the shards' own.
        """
        units, count, edits, _ = ways.arrays()
        even = all((w == 1.0).all() for _, _, w in asked.level)
        # the limit of a node of the asked tree is the largest below it
        reach = limit.copy() if within is None else None
        # and the lengths that are asked for below it, in units
        want = np.isfinite(limit).astype(np.int64)
        told = ways.arrays()[3]
        several = (count >= 0).sum(axis=1) > 1
        made = asked.size
        for depth in range(len(asked.level) - 1, -1, -1):  # from the leaves up
            parent, syllable, _ = asked.level[depth]
            made -= len(parent)
            if depth:
                if within is None:
                    np.maximum.at(reach, parent, reach[made : made + len(parent)])
                for k in range(4):
                    some = told[syllable, k]
                    np.bitwise_or.at(want, parent[some], _further(want[made : made + len(parent)][some], k))
        # what may be spent at an asked node, by the units that can follow
        budget = reach[:, None] if within is None else within
        spans, budget = budget.shape[1], np.ascontiguousarray(budget).reshape(-1)
        for tree, numbers in trees or [(tree, np.arange(base, base + len(tree.row))) for tree, base in zip(self.trees, self.base)]:
            deep = np.minimum(tree.deep, spans - 1)
            after = np.clip(tree.deep - 1, 0, spans - 1)
            at = np.zeros(1, np.int64)
            node, total, spent = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)
            made = before = 0
            for depth, (parent, syllable, weight) in enumerate(asked.level):
                if not len(parent) or not len(at):
                    break
                # every pair goes on with each child of its asked node
                if depth:
                    first = np.searchsorted(parent, np.arange(before, made + 1))
                    lo = first.take(at - before)
                    kids = first.take(at - before + 1) - lo
                    took = np.repeat(np.arange(len(at)), kids)
                    child = np.repeat(lo, kids) + _runs(kids)
                else:
                    child, took = np.arange(len(parent)), np.zeros(len(parent), np.int64)
                self.possible += len(parent) * tree.size
                # single: what no other way can meet
                done, single = [], []
                fine = np.flatnonzero(budget.take((made + child) * spans + deep.take(node.take(took))) >= (total + spent * self.cost - EPS).take(took))
                child, took = child.take(fine), took.take(fine)
                alone = ~several[syllable]
                for slot in range(count.shape[1]):
                    length, edit = count[syllable, slot], edits[syllable, slot]
                    for only in (True, False):
                        # asked nodes of one way, then those of several
                        mine = (length >= 0) & (alone == only)
                        if not mine.any():
                            continue
                        some = np.flatnonzero(mine.take(child))
                        c, from_ = child.take(some), took.take(some)
                        k, now, sums, e = length.take(c), node.take(from_), total.take(from_), spent.take(from_) + edit.take(c)
                        into = single if only else done
                        for p in range(3):
                            over = np.flatnonzero(k == p)
                            if len(over):
                                into.append((c.take(over), now.take(over), sums.take(over), e.take(over)))
                                go = np.flatnonzero(k > p)
                                c, k, now, sums, e = (a.take(go) for a in (c, k, now, sums, e))
                            if not len(c):
                                break
                            # by the longest way down from any child
                            used, first = e * self.cost + sums - EPS, (made + c) * spans
                            most = budget.take(first + after.take(now)) - used
                            go = np.flatnonzero(most >= 0)
                            if len(go) < len(c):
                                c, k, now, sums, e, used, first, most = (a.take(go) for a in (c, k, now, sums, e, used, first, most))
                                if not len(c):
                                    break
                            own = (units[syllable, slot, p] * len(self.grid)).take(c)
                            kids = tree.kids.take(now)
                            ends = np.cumsum(kids)
                            self.visited += int(ends[-1])
                            x = np.repeat(np.arange(len(c)), kids)
                            now = np.arange(int(ends[-1])) + (tree.kid.take(now) - ends + kids).take(x)
                            step = self.flat.take(own.take(x) + tree.code.take(now))
                            if not even:
                                step *= weight.take(c).take(x)
                            near = np.flatnonzero(step <= most.take(x))
                            x, now, step = x.take(near), now.take(near), step.take(near)
                            # a word of a length that is asked for must lie below
                            need = want.take(made + c)
                            if (k > p + 1).any():
                                need = _further(need, k - p - 1)
                            b = np.flatnonzero(tree.below.take(now) & need.take(x))
                            x, now, step = x.take(b), now.take(b), step.take(b)
                            b = np.flatnonzero(budget.take(first.take(x) + deep.take(now)) >= step + used.take(x))
                            x, now = x.take(b), now.take(b)
                            sums = sums.take(x) + step.take(b)
                            e, c, k = e.take(x), c.take(x), k.take(x)
                        else:
                            if len(c):
                                into.append((c, now, sums, e))
                if len(done) > 1:  # ways that meet at a node go on as the cheapest
                    child, node, total, spent = (np.concatenate(x) for x in zip(*done))
                    pair = child * tree.size + node
                    order = np.lexsort((total + spent * self.cost, pair))
                    pair = pair.take(order)
                    order = order[np.r_[True, pair[1:] != pair[:-1]]] if len(order) else order
                    done = [(child[order], node[order], total[order], spent[order])]
                if not (done or single):
                    break
                child, node, total, spent = (np.concatenate(x) for x in zip(*done, *single))
                at = made + child
                hit = np.flatnonzero(tree.rows[node])
                if len(hit):
                    rows = tree.rows[node[hit]]
                    x = np.repeat(hit, rows)
                    row = numbers[tree.row[np.repeat(tree.first_row[node[hit]], rows) + _runs(rows)]]
                    sums = total[x] + (spent[x] + self.vcost[row]) * self.cost
                    near = (sums <= limit[at[x]] + EPS) & np.isfinite(sums)
                    yield at[x][near], row[near], sums[near]
                before = made
                made += len(parent)

    def ordered(self, nodes: np.ndarray, rows: np.ndarray, sums: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, rows, sums, words): by asked node the best row of each id, in rank order. Of an id's equal rows the one read last counts. lengths: bits of each node."""
        word = self.word[rows]
        order = np.lexsort((-self.seq[rows], -self.n_units[rows], sums, word, nodes))
        nodes, rows, sums, word = nodes[order], rows[order], sums[order], word[order]
        if not len(nodes):
            return nodes, rows, sums, word
        first = np.r_[True, (nodes[1:] != nodes[:-1]) | (word[1:] != word[:-1])]
        nodes, rows, sums, word = nodes[first], rows[first], sums[first], word[first]
        order = np.lexsort((self.number[word], ~self.whole[word], sums, nodes))
        nodes, rows, sums, word = nodes[order], rows[order], sums[order], word[order]
        # equals among ids that are no numbers: as first seen
        open_ = np.r_[False, (nodes[1:] == nodes[:-1]) & (sums[1:] == sums[:-1]) & ~self.whole[word[1:]] & ~self.whole[word[:-1]]]
        begin = np.flatnonzero(open_ & ~np.r_[False, open_[:-1]]) - 1
        end = np.flatnonzero(open_ & ~np.r_[open_[1:], False]) + 1
        order = np.arange(len(nodes))
        for a, b in zip(begin.tolist(), end.tolist()):
            bits = int(lengths(int(nodes[a])))
            order[a:b] = sorted(range(a, b), key=lambda x: self.key(int(word[x]), bits))
        return nodes[order], rows[order], sums[order], word[order]

    def ranked(self, nodes: np.ndarray, rows: np.ndarray, sums: np.ndarray, lengths) -> dict[int, list[tuple[float, int, int]]]:
        """What ordered tells, as (sum, word, row) by asked node."""
        nodes, rows, sums, word = self.ordered(nodes, rows, sums, lengths)
        cut = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1], True]) if len(nodes) else [0]
        s, w, r = sums.tolist(), word.tolist(), rows.tolist()
        return {int(nodes[a]): list(zip(s[a:b], w[a:b], r[a:b])) for a, b in zip(cut[:-1], cut[1:])}


def lengths_of(ways: Ways, asked: Asked) -> np.ndarray:
    """The numbers of units in which each asked node can be said, as bits; as Python numbers, so that any length fits."""
    _, _, _, told = ways.arrays()
    out = np.zeros(asked.size, object)
    made = 0
    for depth, (parent, syllable, _) in enumerate(asked.level):
        before = out[parent] if depth else np.full(len(parent), 1, object)
        now = np.zeros(len(parent), object)
        for k in range(4):
            now = now | np.where(told[syllable, k], before << k, 0)
        out[made : made + len(parent)] = now
        made += len(parent)
    return out
