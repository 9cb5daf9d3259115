"""Limits of runs: what a run can cost at most, and how they rise for light runs."""

from __future__ import annotations

import random

from hibiki.operators import distance, lattice, segment
from test_lattice import lines_of, word_table


P = segment.DEFAULTS | {"VARIATION_COST": 2.5, "DUPLICATE": False}


def held(spark, words):
    return lattice.held(lattice.index(words, distance.unit_matrix(spark), 2.5).shared())


def test_runs_whose_words_are_all_used_are_given_up(spark, monkeypatch):
    """No word costs more than a run's units can: a used-up run of one unit is not walked up to the sums of long words."""
    rows = [("a", 1, 0, ["カ"], 0), ("b", 1, 1, ["キ"], 0), ("long", 12, 2, ["カ"] * 12, 0)]
    own = held(spark, spark.createDataFrame(rows, "id string, n_units int, seq long, units array<string>, vcost int"))
    lines = lines_of(random.Random(2), 5, 1, ("カ",))
    finds, find = [], lattice.Batch.find
    monkeypatch.setattr(lattice.Batch, "find", lambda self, wanted: finds.append(1) or find(self, wanted))
    got = lattice.covered(own, P, [(lines, set())])
    assert [r[5] for r in got] == ["a", "b", None, None, None]
    assert len(finds) <= 3


def test_light_runs_do_not_find_all_words(spark):
    """Limits rise with a run's weight, so that runs of little weight do not list every word."""
    own = held(spark, word_table(spark, random.Random(6), 500, 100)[1])
    lines = lines_of(random.Random(7), 60, 8)
    for r in lines:
        r.weights = [2.0, 2.0, 2.0, *[0.4] * 5]
    ways = lattice.Ways(own.place)
    batch = lattice.Batch(own, P, ways, [lattice._line(ways, r) for r in lines], [set() for _ in lines])
    batch.prepare()
    assert len(batch.kept[0]) < 10 * len(batch.done)
