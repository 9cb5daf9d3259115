"""Lines of one song, which depend on each other, share the walks of their runs."""

from __future__ import annotations

import random

from hibiki.operators import distance, lattice, segment
from test_lattice import lines_of, word_table


def test_lines_of_a_song_share_their_walks(spark, monkeypatch):
    """Runs of all lines of a song are walked together, and the words are those of its lines covered one by one."""
    rng = random.Random(6)
    _, words = word_table(spark, rng, 500, 100)
    own = lattice.held(lattice.index(words, distance.unit_matrix(spark), 2.5).shared())
    lines = [r for r in lines_of(rng, 100, 8) if r.song == 0]
    p = segment.DEFAULTS | {"VARIATION_COST": 2.5, "DUPLICATE": False}
    busy: set = set()
    walks, walk = [], type(own).walk
    monkeypatch.setattr(type(own), "walk", lambda *a: walks.append(1) or walk(*a))
    alone = [x for r in lines for x in lattice.covered_songs(own, p, [r], busy)]
    one_by_one = len(walks)
    walks.clear()
    assert len(lines) > 2
    assert lattice.covered(own, p, [(lines, set())]) == alone
    assert len(walks) < 0.8 * one_by_one  # as many before, with a batch for each line
