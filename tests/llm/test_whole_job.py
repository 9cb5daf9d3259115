"""Cases that operators once cut short, against brute force."""

from __future__ import annotations

import collections
import random

import pytest

from hibiki.llm import decontam, html, quality, substring

WORDS = [a + b for a in ("ka", "mo", "ri", "te", "su", "no") for b in ("lan", "der", "vit", "os", "ba", "quen", "zi")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_truncated_copy_beside_two_whole_ones(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(200):
        w = prose(rng, 160).split()
        a, b = sorted(rng.sample(range(161), 2))
        texts += [" ".join(w)] * 2 + [" ".join(w[a : max(b, a + 40)])]
        texts += [prose(rng, 20) + " " + " ".join(w[20:120]) + " " + prose(rng, 30)] if rng.random() < 0.3 else []
    seen = collections.Counter(tuple(w[i : i + 35]) for w in map(str.split, texts) for i in range(len(w) - 34))
    want = {}
    for k, w in enumerate(map(str.split, texts)):
        hit = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[k] = (len(hit), " ".join(x for j, x in enumerate(w) if j not in hit))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()}
    assert [k for k in want if got[k] != want[k]] == []


@pytest.mark.parametrize("unseen", [False, True])
def test_paraphrases_are_found(spark, unseen):
    rng = random.Random(8)
    wide = [a + b for a in WORDS for b in WORDS]
    items = [(i, " ".join(rng.choices(wide, k=38)) + ". " + " ".join(rng.choices(wide, k=8)) + ".") for i in range(40)]
    rows, want = [(k, " ".join(rng.choices(wide, k=200))) for k in range(60)], set()
    for i, t in items:
        w, answer = decontam.word_list(t), decontam.last_sentence(t)
        for share in (0.15, 0.25, 0.35):
            y = [(f"zq{rng.randrange(1 << 24)}" if unseen else rng.choice(wide)) if rng.random() < share else x for x in w]
            common = decontam.common_words(w, y) / len(w)
            if common >= decontam.COPY or common >= decontam.PARAPHRASE and decontam.common_words(answer, y) >= decontam.ANSWER * len(answer):
                want.add((len(rows), i))
            rows.append((len(rows), " ".join([*rng.choices(wide, k=70), *y, *rng.choices(wide, k=60)])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > 80 and want <= got, len(want - got)


def test_wrapper_decides_within_and_between_articles():
    rng = random.Random(2)
    page = "<body><div><article><h1>{}</h1><p>{}</p><p>By <b>{}</b></p><div><p>Read our terms</p></div></article></div><section><article><p>{}</p></article><article><p>{}</p></article></section>"
    said = [(prose(rng, 3), prose(rng, 60), prose(rng, 2), prose(rng, 4), prose(rng, 4)) for _ in range(5)]
    pages = [page.format(*x) for x in said]
    w = html.Wrapper(pages[0], *html.induce(pages[:4]))
    for x, p in zip(said, pages):
        assert w.extract(p) == f"{x[0]}\n{x[1]}\nBy {x[2]}"
    other = pages[4].replace("our terms", "on")
    assert w.extract(other).endswith("Read on")
    copies = html.Wrapper(pages[0], *html.induce(pages[:1] * 4))
    assert said[0][1] in copies.extract(pages[0])


def test_stage_links_what_is_similar(spark):
    """The pipeline's near duplicates against all pairs: only similar texts are linked, and nearly all of them."""
    from hibiki.llm import simhash

    rng = random.Random(21)
    wide = [a + b for a in WORDS for b in WORDS]
    texts = [" ".join(rng.choices(wide, k=rng.choice([3, 60, 150]))) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        for share in (0.005, 0.01, 0.02, 0.05):
            texts.append(" ".join(rng.choice(wide) if rng.random() < share else x for x in w))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {find(i) for i in range(len(texts))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert want <= got  # no text goes that has no similar one before it
    assert len(got - want) <= 0.05 * (len(texts) - len(want)), (len(got), len(want))


def test_positions_beyond_a_stretch(monkeypatch):
    """Nodes of a text longer than a stretch of positions are those of the text as a whole."""
    import numpy as np

    rng = random.Random(3)
    s = substring.Spans([[rng.choice(WORDS).encode() for _ in range(500)]])
    at, node = s.windows()
    width = s.window - s.k + 1
    for a, n in zip(at.tolist(), node.tolist()):
        h = s.hash(np.arange(a, a + width), np.arange(a, a + width) + s.k) & ~np.uint64(0xFFFFFF)
        assert n == a + int(np.argmin(h))


def test_windows_whose_first_hashes_clash_stay(spark):
    """Windows recur only if both hashes agree; accepted windows count; hot and rare hashes go by different joins."""
    rows = [(1, 0, 5, 77, 1), (2, 0, 9, 77, 2), (3, 0, 1, 88, 3), (4, 0, 2, 99, 4), (5, 0, 3, 99, 5)]
    rows += [(100 + i, 0, 0, 7, 7) for i in range(5000)] + [(9000, 0, 0, 6, 6), (9000, 0, 1, 6, 6), (9001, 0, 4, 6, 6)]
    windows = spark.createDataFrame(rows, "k long, th long, wpos int, whash long, wcheck int")
    accepted = spark.createDataFrame([(88, 3), (99, 6), (5, 5), (5, 5)], "whash long, wcheck int")
    got = {r.k: sorted(r.hit) for r in substring.recurring(windows, accepted).collect()}
    assert got == {3: [1], 9000: [0, 1], 9001: [4]} | {100 + i: [0] for i in range(5000)}
    hot = {r.n: r.hot for r in substring.hot_keys(spark.createDataFrame([(1, 5000), (2, 2)], "h long, n long")).collect()}
    assert hot == {5000: True, 2: False}


def test_the_second_hash_tells_spans_by_their_words_alone():
    import numpy as np

    rng = random.Random(8)
    one = [rng.choice(WORDS).encode() for _ in range(300)]
    s, t = substring.Spans([one]), substring.Spans([one[40:], one])
    a = np.arange(200)
    assert (s.check(a + 40, a + 75) == t.check(a, a + 35)).all() and (s.check(a, a + 35) == t.check(a + 260, a + 295)).all()
    assert len(set(s.check(a, a + 35).tolist())) == len({tuple(one[i : i + 35]) for i in range(200)})


def test_context_vectors_and_pooling_word_by_word(spark):
    """Random indexing restated with plain loops: context sums over all documents, and the pooled features of each text."""
    import numpy as np

    rng = random.Random(21)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(40)] + ["Ka, KA! ka ka", "x\ny\nx\n", "", None, " ", "9a $5 (lan) LAN", prose(rng, 3_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sums, counts = quality.corpus_vectors(docs)
    known = quality.Tokens()
    dims, signs = quality.index_vectors()
    want, times = collections.defaultdict(float), collections.Counter()
    laid = [quality.buckets(t, known) for t in texts]
    for ids in laid:
        times.update(ids)
        for i, u in enumerate(ids):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    for k in (0, 1):
                        want[u, int(dims[k][ids[j]])] += signs[k][ids[j]]
    dense = np.zeros((quality.BUCKETS, quality.DIM))
    for at, x in want.items():
        dense[at] = x
    assert np.allclose(sums, dense) and {i: int(c) for i, c in enumerate(counts) if c} == dict(times)
    vectors = quality.word_vectors(sums, counts)
    got = quality.pooled(texts, vectors, known)
    for row, ids in zip(got, laid):
        mean, heavy, weight = np.zeros(quality.DIM), np.zeros(quality.DIM), 0.0
        for u in ids:
            rare = 1e-3 / (1e-3 + times[u] / sum(times.values()))
            mean += vectors[u, : quality.DIM] / len(ids)
            heavy += rare * vectors[u, : quality.DIM]
            weight += rare
        want_row = [*mean, *(heavy / (weight + 1e-6) if ids else heavy), np.log1p(len(ids)) / 5]
        assert np.allclose(row, want_row, atol=1e-4)
    assert quality.corpus_vectors(docs.where("false"))[1].sum() == 0
