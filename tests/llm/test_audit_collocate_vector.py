"""Filter audit, collocations and vector packing against plain restatements."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hibiki.llm import audit, collocate, queries, vectorpack

# -- filter audit ------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, part string, word string, copies int, fails int, n_words string"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, x, _ in docs:
        if i is not None:
            least[x or ""] = min(least.get(x or "", i), i)
    rows = defaultdict(list)
    for i, x, lang in docs:
        x = x or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x),
            "D": re.search("[#$%&*|]", x) is not None,
            "E": x in least and (i is None or least[x] < i),
        }
        rows[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, those in rows.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in those if f in r[0] and not r[0] & before]
                out[part, "".join(order), k + 1] = (
                    sum(not r[0] & (before | {f}) for r in those), len(gone), sum(f in r[0] and bool(r[0] & before) for r in those), sum(r[0] == {f} for r in those), sum(r[1] for r in gone), sum(r[2] for r in gone),
                )
                shapley[part, f] += len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def audit_rows(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash", "w", 7, 9, None) for r in docs], DOCS)
    got = audit.audited(d, spark.createDataFrame([(*r, "p") for r in labels], LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    docs = []
    for i in range(120):
        n = rng.choice([0, 1, 199, 200, 201, 400])
        ws = [f"{rng.choice('abcXY')}{rng.randrange(rng.choice([5, 99, 900]))}" for _ in range(n)]
        text = rng.choice([" ", "\t", "\n", "  "]).join(ws) + rng.choice(["", "", "#", " end*", "É" * 40])
        docs.append((i, text, rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, docs[rng.randrange(60)][1], rng.choice(["en", "fr"])) for i in range(60)]  # copies
    docs += [docs[3], docs[3], docs[70], (5, "other text", "en"), (None, docs[9][1], "en"), (None, "lonely", "en"), (None, "lonely", "en"), (None, None, None), (400, "", "en"), (0, "lonelier", "en"), (-7, docs[10][1], "en")]
    docs += [(300 + i, "one copied text", "hot") for i in range(200)]
    docs.append((999, "Wide " * 60_000, "en"))
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(150)] + [(3, 1, None), (3, None, 1), (None, 1, 1), (12_345, 1, 1)]
    assert audit_rows(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert audit_rows(spark, [], []) == {}
    got = audit_rows(spark, [(1, "a", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


# -- collocations ------------------------------------------------------------------------------------


def plain_pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_collocations(docs, least, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        for p in plain_pieces(text):
            total[lang or "und"] += len(p)
            for k in range(1, 5):
                count[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in count.items():
        rows = []
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i, x.decode(), -a, l, r, total[lang], -s) for i, (s, a, x, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def collocation_docs():
    rng = random.Random(6)
    ws = ["a", "b", "New", "york", "city", "it", "is", "ÉÀ", "éà", "日本", "x y", "z-z"]
    docs = []
    for i in range(150):
        text = ""
        for _ in range(rng.randrange(1, 40)):
            text += rng.choice([rng.choice(ws), "new YORK City", "it is a", "it is", f"rare{rng.randrange(60)}"]) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"])
        docs.append((text, rng.choice(["en", "en", "fr", None])))
    docs += [(docs[0][0], "en")] * 30 + [(None, "en"), ("", "fr"), (" . , ", None), ("it is a " * 5_000, "und"), ("a a a a a a", "fr")]
    return docs


@pytest.mark.parametrize("words, bits", [(2_000_000, 1 << 26), (300, 1 << 26), (2_000_000, 1 << 7)])
def test_collocations_against_counting(spark, monkeypatch, words, bits):
    """Also over many small shards, and with a filter so small that it lets nearly everything through."""
    monkeypatch.setattr(collocate, "SHARD_WORDS", words)
    monkeypatch.setattr(collocate, "FILTER_BITS", bits)
    docs = collocation_docs()
    df = spark.createDataFrame([(t, lang, "clash", 1, 2) for t, lang in docs], "text string, lang string, phrase string, n int, k int").repartition(3)
    for least, top in ((5, 2_000), (8, 10)):
        got = sorted(tuple(r) for r in collocate.mined(df, least, top).collect())
        assert got == plain_collocations(docs, least, top) and got


def test_collocations_of_nothing(spark):
    assert collocate.mined(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_collocation_numbers_past_64_bits(spark):
    big = 1 << 58
    rows = [("en", "a", 3 * big, 1), ("en", "b", 2 * big, 1), ("en", "c", 2 * big, 1), ("en", "a b", 2 * big, 2), ("en", "b c", big, 2), ("en", "a b c", big, 3)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, n long, k int")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocate.scored(phrases).collect()}
    want = {"a b": (2 * big, 3 * big, 2 * big), "b c": (big, 2 * big, 2 * big), "a b c": (big, 3 * big, big)}
    assert got == {p: (a, l, r, 2_000_000 * a // (l + r)) for p, (a, l, r) in want.items()}
    assert {(r.phrase, r.most) for r in collocate.subsumers(phrases).collect()} == {("a b", big), ("b c", big)}


def test_automaton_states_are_end_place_classes():
    rng = random.Random(2)
    for depth in (1, 2, 4):
        for _ in range(20):
            seqs = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
            codes = np.array([c for s in seqs for c in (0, *s)], np.int32)
            times = [rng.randrange(1, 5) for _ in seqs]
            weight = np.array([n for s, n in zip(seqs, times) for _ in range(len(s) + 1)], np.int64)
            at = collocate.Automaton(codes, weight, depth)
            ends, count = defaultdict(set), Counter()
            base = 0
            for s, n in zip(seqs, times):
                for i in range(len(s)):
                    for d in range(1, min(depth, i + 1) + 1):
                        sub = tuple(s[i - d + 1 : i + 1])
                        ends[sub].add(base + 1 + i)
                        count[sub] += n
                base += len(s) + 1
            classes = defaultdict(list)
            for sub, e in ends.items():
                classes[frozenset(e)].append(sub)
            assert len(at.place) == len(classes)
            state = {}
            for s in range(len(at.place)):
                for d in range(at.shortest[s], at.longest[s] + 1):
                    sub = tuple(codes[at.place[s] - d + 1 : at.place[s] + 1].tolist())
                    assert sub not in state and at.count[s] == count[sub]
                    state[sub] = s
            assert set(state) == set(ends)
            for sub, s in state.items():
                up = sub[1:]
                while up and state[up] == s:
                    up = up[1:]
                assert at.link[s] == (state[up] if up else -1)


# -- vector packing ----------------------------------------------------------------------------------


def check_pieces(examples, limits, pieces, downsize=True):
    for i, e in enumerate(examples):
        own = sorted((p.start, p.length) for p in pieces if p.example == i)
        assert [a for a, _ in own] == list(itertools.accumulate([0, *(n for _, n in own[:-1])])) if own else e.n == 0
        assert sum(n for _, n in own) == e.n and all(n > 0 for _, n in own)
    for s in range(1 + max((p.sequence for p in pieces), default=-1)):
        own = sorted((p for p in pieces if p.sequence == s), key=lambda p: p.offset)
        assert own and [p.offset for p in own] == list(itertools.accumulate([0, *(p.length for p in own[:-1])]))
        used = sum(p.length for p in own)
        assert used <= limits.tokens and len(own) <= limits.segments and sum(p.loss for p in own) <= limits.loss
        assert all(p.loss == examples[p.example].loss(p.start, p.start + p.length) for p in own)
        assert not downsize or used == limits.tokens or used & (used - 1) == 0


def plain_fill(examples, limits):
    """Sequences of (example, start, length) by the same heuristic, over a plain list of rests."""
    total = [sum(e.n for e in examples), len(examples), sum(e.loss(0, e.n) for e in examples)]
    weight = [t / c for t, c in zip(total, limits)]
    rests, out = [], []

    def put(i, start):
        e = examples[i]
        while (n := e.reach(start, limits.tokens, limits.loss)) == limits.tokens and start + n < e.n:
            out.append([(i, start, n)])
            start += n
        rests.append((i, start, (e.n - start, 1, e.loss(start, e.n))))

    for i in range(len(examples)):
        put(i, 0)
    first = {}
    while rests:
        free, held = list(limits), []
        while free[0] and free[1] and rests:
            for _, _, d in rests:
                first.setdefault(d, len(first))
            fits = [r for r in rests if all(a <= b for a, b in zip(r[2], free))]
            if fits:
                score = lambda d: sum(w * f / c**2 * x for w, f, c, x in zip(weight, free, limits, d))
                best = max(score(r[2]) for r in fits)
                pick = min((first[r[2]] for r in fits if score(r[2]) >= best * (1 - 1e-12)))
                i, start, d = [r for r in fits if first[r[2]] == pick][-1]
                n = d[0]
                rests.remove((i, start, d))
            else:
                i, start, d = sorted(rests, key=lambda r: (-r[2][0], r[2][2]))[0]
                i, start, d = [r for r in rests if r[2] == d][-1]
                n = examples[i].reach(start, free[0], free[2])
                rests.remove((i, start, d))
                put(i, start + n)
                if not n:
                    break
            held.append((i, start, n))
            free = [free[0] - n, free[1] - 1, free[2] - examples[i].loss(start, start + n)]
        if held:
            out.append(held)
    return out


def test_vector_packing_follows_the_dot_product():
    rng = random.Random(9)
    for turn in range(60):
        limits = vectorpack.Limits(rng.choice([8, 30, 64]), rng.choice([2, 4, 9]), rng.choice([3, 20, 64]))
        examples = []
        for _ in range(rng.randrange(1, 25)):
            n = rng.choice([1, 2, 3, 7, 20, 64, 150])
            losses = None if turn % 2 else np.r_[0, np.cumsum([rng.random() < 0.4 for _ in range(n)])]
            examples.append(vectorpack.Example(n, losses))
        for downsize in (True, False):
            check_pieces(examples, limits, vectorpack.fill(examples, limits, downsize), downsize)
        got = defaultdict(list)
        for p in vectorpack.fill(examples, limits, False):
            got[p.sequence].append((p.example, p.start, p.length))
        assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for x in plain_fill(examples, limits))


def test_vector_packing_edges():
    assert vectorpack.fill([], vectorpack.Limits()) == []
    assert vectorpack.powers(2_300) == [2048, 128, 64, 32, 16, 8, 4] and vectorpack.powers(0) == []
    with pytest.raises(ValueError):
        vectorpack.fill([vectorpack.Example(3)], vectorpack.Limits(0, 1, 1))
    tight = vectorpack.Limits(4096, 2, 4096)
    check_pieces(e := [vectorpack.Example(1) for _ in range(9)], tight, vectorpack.fill(e, tight))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def whole_ids(tokenizer, text, end=2):
    from tokenizers import Tokenizer

    t = tokenizer if not isinstance(tokenizer, str) else Tokenizer.from_file(tokenizer)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op13_against_whole_texts(spark, tokenizer, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta,", "日本", "émile", "x1"]) for _ in range(rng.choice([0, 1, 3, 300, 2_000])))) for i in range(60)]
    docs += [(7, "again seven"), (None, "no id"), (100, None), (101, ""), (102, "long text " * 20_000), (None, None), (7, "again seven")]
    spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, sequence_id string, offset int").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = queries.op13_vector_packing(spark, f"file://{tmp_path}").collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(itertools.accumulate([0, *(r.length for r in own[:-1])]))
        used = sum(r.length for r in own)
        assert used == 4096 or (used < 4096 and used & (used - 1) == 0)
        assert len(own) <= vectorpack.Limits().segments
    ids = [(i, whole_ids(tokenizer, t)) for i, t in docs]
    want = Counter((i, len(x)) for i, x in ids)
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    once = {i: x for i, x in ids if sum(j == i for j, _ in ids) == 1}
    for i, x in once.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [c for _, _, c in own] == [crc(x[a : a + n]) for a, n, _ in own] and sum(n for _, n, _ in own) == len(x)
        assert [a for a, _, _ in own] == list(itertools.accumulate([0, *(n for _, n, _ in own[:-1])]))


def test_vector_packing_of_dialogues(spark, tokenizer):
    """Only the answers bear loss; all three limits hold at once, over several blocks."""
    rng = random.Random(1)
    rows = [(i, [(" ".join(["word"] * rng.randrange(1, 90)), k % 2 == 1) for k in range(rng.randrange(1, 9))]) for i in range(80)]
    rows += [(80, None), (81, []), (82, [None, (None, True), ("x", None)])]
    df = spark.createDataFrame(rows, "doc_id long, parts array<struct<text:string,loss:boolean>>").repartition(2)
    limits = vectorpack.Limits(256, 5, 100)
    got = vectorpack.pack(df, tokenizer, limits, block_tokens=3_000).collect()
    loss = {}
    for i, parts in rows:
        marks = []
        for p in parts or []:
            if p is not None:
                marks += [bool(p[1])] * (len(whole_ids(tokenizer, p[0])) - 1)
        fine = [p for p in parts or [] if p is not None]
        loss[i] = [*marks, bool(fine and fine[-1][1])]
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in loss.items()}
    for r in got:
        assert r.loss_tokens == sum(loss[r.doc_id][r.start : r.start + r.length])
    totals = defaultdict(lambda: [0, 0, 0])
    for r in got:
        t = totals[r.sequence_id]
        t[0], t[1], t[2] = t[0] + r.length, t[1] + 1, t[2] + r.loss_tokens
    assert all(t[0] <= 256 and t[1] <= 5 and t[2] <= 100 for t in totals.values())
    assert len({r.sequence_id >> 32 for r in got}) == 2 and sum(t[0] == 256 for t in totals.values()) > 20
    assert vectorpack.pack(df.limit(0), tokenizer).collect() == []
