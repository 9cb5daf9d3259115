"""The training-data operators against brute force, on small fixtures with nulls, blanks, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hibiki.llm import decontam, html, packing, quality, rules, simhash, substring, tokens, toxicity, urls
from hibiki.llm.common import components

WORDS = [a + b for a in ("ka", "mo", "ri", "te", "su", "no") for b in ("lan", "der", "vit", "os", "ba", "quen", "zi")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(4)
    passage = prose(rng, 60)
    out: list[str | None] = [prose(rng, rng.choice([5, 40, 120, 300])) for _ in range(40)]
    out[3] = prose(rng, 120)
    out += [out[3], out[3], "", None, "  \n ", "one", prose(rng, 30) + " " + passage, passage + "\n" + prose(rng, 50), passage + " " + passage]
    base = prose(rng, 400).split()
    for i in range(6):
        copy = list(base)
        copy[50 * i] = "changed"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y", "z"), (None, texts[4], "x", "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, key string, h string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


# -- SimHash


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(texts):
    for t in [*texts, "A b\tC\x0bd e", "Ärger ÄRGER straße x y"]:
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


def groups_by_force(rows):
    link = {i: i for i in range(len(rows))}

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                link[root(i)] = root(j)
    out = []
    for i, (d, f) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f, min(ids, default=None)))
    return out


def test_simhash_groups(docs, nothing):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()]
    want = groups_by_force([(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.groups(nothing).count() == 0


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_links_lose_no_pair(spark, bits, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)  # so that buckets are cut into blocks
    rng = np.random.default_rng(bits)
    centre = int(rng.integers(1 << 62))
    fps = {0, centre}
    for _ in range(300):
        x = centre if rng.random() < 0.7 else int(rng.integers(1 << 62))
        for b in rng.integers(0, 64, rng.integers(0, bits + 3)):
            x ^= 1 << int(b)
        fps.add(x - (1 << 64) if x >> 63 & 1 else x)
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) % (1 << 64)).count("1") <= bits:
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for f in fps:
        least[find(f)].append(f)
    assert {f: min(least[find(f)]) for f in fps} == {f: roots.get(f, f) for f in fps}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), *((100, i) for i in range(101, 160))], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 160)}


def test_representatives(docs):
    best = simhash.representatives(docs).collect()
    assert len({(r.doc_id, r.seal) for r in best}) == len(best) and any(r.again for r in best if r.doc_id == 3)


# -- tokens


def test_tokens(spark, docs, nothing):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "İstanbul ΣΑΣ <|ENDOFTEXT|>x. y,. z<|endoftext|>", "", "", ""), (901, "a\x1cb I'll, o'k. ﬁ 漢字", "", "", "")], docs.schema)
    rows = [r for r in docs.unionByName(extra).collect() if r.doc_id is not None]
    uniq = docs.unionByName(extra).where("doc_id IS NOT NULL")
    start, want = 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in tokens.tokenized(uniq, path).collect())
    assert got == sorted(want)
    assert tokens.tokenized(docs, path).count() == docs.count()
    assert tokens.tokenized(nothing, path).count() == 0


def test_index_decides(spark, docs):
    """A slot that leads elsewhere, and a key that the index has not, are errors."""
    import glob
    import os

    public = pytest.importorskip("public_tokenizers")
    path = tokens.new_path(spark, "broken")
    tokens.write_shards(docs, public.path("word_bpe_49k.json"), path)
    classes = tokens.write_index(spark, path)
    keys = docs.select(F.col("doc_id").alias("key"))
    assert tokens.read_back(keys, path, classes).count() == docs.count()
    with pytest.raises(Exception, match="no record"):
        tokens.read_back(keys.unionByName(spark.createDataFrame([(123456,)], "key long")), path, classes).collect()
    [name] = [n for n in glob.glob(path.removeprefix("file://") + "/index/kind=index/sub=*/part*") if os.path.getsize(n)]
    raw = bytearray(open(name, "rb").read())
    size = tokens.SLOT.itemsize
    last = len(raw) - 1 - size  # the byte that ends the record comes last
    slot = np.frombuffer(bytes(raw[last : last + size]), tokens.SLOT).copy()
    slot["at"] += 1
    raw[last : last + size] = slot.tobytes()
    open(name, "wb").write(raw)
    for crc in glob.glob(os.path.dirname(name) + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(Exception, match="wrong record"):
        tokens.read_back(keys, path, classes).collect()


def test_counted(docs):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tokens.counted(docs, path, ["doc_id"]).collect())
    assert got == sorted((r.doc_id or -1, r.n_tokens) for r in tokens.tokenized(docs, path).collect())


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))
    mph = tokens.PerfectHash.build(keys)
    assert sorted(mph.slot(keys).tolist()) == list(range(len(keys)))
    raw = tokens.build_class(keys, 1, 0, np.arange(len(keys)), 7)
    there, rec = tokens.find_in_class(raw, keys)
    assert there.all() and (rec["at"] == np.arange(len(keys))).all()
    assert tokens.find_in_class(raw, keys + (1 << 62))[0].mean() < 0.01
    assert not tokens.find_in_class(tokens.build_class(keys[:0], 0, 0, 0, 0), keys[:3])[0].any()


# -- substrings


def test_substring(docs, nothing):
    rows = docs.collect()
    seen = collections.Counter()
    for r in rows:
        w = (r.text or "").encode().split()
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = (r.text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, digest=True, carry=["h"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 500
    assert substring.remove_repeats(nothing).count() == 0


# -- rules


def slow_repeats(w):
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_rules(spark, docs, nothing):
    odd = spark.createDataFrame([(500, "a b c a b c a\nx\nx\n \n", "", "", ""), (501, "### $$ | <p> " * 30, "", "", ""), (502, "LOUD!! " * 60, "", "", "")], docs.schema)
    rows = docs.unionByName(odd)
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines) for r in rules.scored(rows).collect()}
    want = set()
    for r in rows.collect():
        w = (r.text or "").split()
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        want.add((r.doc_id, len(w), slow_repeats(w), len(lines) - len(set(lines))))
    assert got == want
    assert {r.doc_id for r in rules.scored(odd).collect() if r.kept} == set()
    a = {(r.doc_id, r.rejected_by is None) for r in rules.judge(rows).collect()}
    assert a == {(r.doc_id, r.kept) for r in rules.scored(rows).collect()}
    assert rules.scored(nothing).count() == 0


# -- packing


def test_packing(spark, docs, nothing):
    rng = random.Random(1)
    lengths = [rng.randint(0, 64) for _ in range(500)]
    where, at, caps = packing.pack_lengths(lengths, (16, 32, 64), 2)
    used = collections.defaultdict(list)
    for n, b, a, c in zip(lengths, where, at, caps):
        used[b].append((a, n, c))
    for pieces in used.values():
        end = 0
        for a, n, c in sorted(pieces):
            assert a == end
            end = a + n
        assert end <= c and c == min(x for x in (16, 32, 64) if x >= end)
    assert sum(p[0][2] for p in used.values()) < 1.1 * sum(lengths)
    assert len({c for c in caps}) > 1  # several capacities are in use
    got = packing.pack(docs, capacities=(32, 64), block_pieces=50).collect()
    total = collections.Counter()
    for r in got:
        total[r.doc_id] += r.length
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len((r.text or "").split()) + 1
    assert total == want and packing.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack_lengths([65], (64,))


def test_packing_plan_against_every_plan():
    """The joint choice costs no more than any one capacity, and near the least cost of all partitions of a few pieces."""

    def partitions(items):
        if not items:
            yield []
            return
        for p in partitions(items[1:]):
            yield [[items[0]], *p]
            for i in range(len(p)):
                yield [*p[:i], [items[0], *p[i]], *p[i + 1 :]]

    rng, caps = random.Random(6), (16, 32, 64)
    worst = 0.0
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 7))]
        price = {c: packing.bin_price(c, 3, 256) for c in caps}
        cost = lambda bins: sum(min((price[c] for c in caps if c >= sum(b)), default=1e9) for b in bins)
        where, _, final = packing.pack_lengths(lengths, caps, 3, 256)
        mine = sum(price[c] for c in dict(zip(where, final)).values())
        best = min(map(cost, partitions(lengths)))
        assert mine >= best - 1e-9
        worst = max(worst, mine / best)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        assert mine <= packing._plan(lengths, order, [64], price, list(caps))[0] + 1e-9
    assert worst < 1.25, worst


# -- classifiers


def labelled(spark, bad: str, n: int = 400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        flag = i % 3 == 0
        w = prose(rng, 60).split()
        if flag:
            for _ in range(8):
                w[rng.randrange(len(w))] = bad
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(flag)))
    rows += [(n, None, "s"), (n + 1, "", "s"), (5, rows[5][1], "s"), (None, "x", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, y int"), dict(labels)


@pytest.mark.parametrize(("module", "bad"), [(quality, "###"), (toxicity, "grimple")])
def test_classifiers(spark, module, bad):
    rows, labels, truth = labelled(spark, bad)
    got = module.scored(rows, labels, "y").collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    parts, out = (4, 2) if module is quality else (5, 0)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == out) for r in got)
    assert module.scored(rows.limit(0), labels, "y").count() == 0
    assert len({r.score for r in module.scored(rows, labels.limit(0), "y").collect()}) == 1


def test_toxic_spans(spark):
    rows, labels, truth = labelled(spark, "grimple")
    by = {r.doc_id: r.spans for r in toxicity.scored(rows, labels, "y").collect()}
    text = {r.doc_id: r.text for r in rows.collect()}
    assert {text[0][s.start : s.end] for s in by[0]} == {"grimple"} and by[1] == []


def test_marginals_against_plain_recursion():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 70, 3, 200])
    logit = rng.normal(size=sizes.sum())
    step, start = np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.8, 0.2])
    p = toxicity.marginals(logit, sizes, step, start)[0]
    at = 0
    for n in sizes:
        phi = np.stack([np.ones(n), np.exp(logit[at : at + n])], 1)
        f, b = [start * phi[0]], [np.ones(2)]
        for i in range(1, n):
            f.append((f[-1] @ step) * phi[i])
            f[-1] /= f[-1].sum()
        for i in range(n - 1, 0, -1):
            b.append(step @ (phi[i] * b[-1]))
            b[-1] /= b[-1].sum()
        g = np.array(f) * np.array(b[::-1])
        assert np.allclose(p[at : at + n], g[:, 1] / g.sum(1))
        at += n


# -- decontamination


def test_decontamination(spark, nothing):
    rng = random.Random(12)
    wide = [a + b + c for a in ("ka", "mo", "ri", "te") for b in ("lan", "der", "vit", "os", "ba") for c in ("quen", "zi", "tor", "mal", "pes", "un")]
    text = lambda n: " ".join(rng.choice(wide) for _ in range(n))
    items = [(i, text(40) + ". " + text(8) + ".") for i in range(12)]
    rows = [(i, text(200)) for i in range(60)]
    rows += [(100 + i, text(80) + " " + t + " " + text(60)) for i, t in items]
    near = [(200 + i, text(50) + " " + " ".join(w for k, w in enumerate(t.split()) if k % 9) + " " + text(50)) for i, t in items]
    docs = spark.createDataFrame([*rows, *near, (300, None), (301, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    want = {(100 + i, i) for i, _ in items} | {(200 + i, i) for i, _ in items}
    assert got <= want and len(got) >= 0.9 * len(want) and {(100 + i, i) for i, _ in items} <= got
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_common_words():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(50):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        assert decontam.common_words(a, b) == slow(a, b)


# -- pages


PAGE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">x</a></ul></nav><div class="ad">Buy</div><article><h1>Head&amp;line</h1><p><b>One  two<br>three<p>Four</p><!-- no --><aside>side</aside><form>f</form></article><section id="comments"><p>first!</p></section><footer>&copy; me</footer>'


def test_html(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.replace("Four", f"Four {i}")) for i in range(8)]
    rows += [(90, "http://h0.example.com/q", None), (91, None, "<p>a</p> b <div class='cookie notice'>c</div>"), (92, "http://h1.example.com/", ""), (93, "http://h0.example.com/z", "<body>" + "<div>" * 300 + "deep")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == f"Head&line\nOne two three\nFour {i}" for i in range(8))
    assert got[90] == "" and got[91] == "a\nb" and got[92] == "" and got[93] == "deep"
    assert html.extract(df.limit(0)).count() == 0


def test_tree_matching():
    def slow(a, b):
        if a.tag != b.tag:
            return 0
        x, y = html.elements(a), html.elements(b)
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + slow(p, q))
        return t[-1][-1] + 1

    rng = random.Random(5)

    def tree(depth):
        x = html.Node(rng.choice("ab"))
        x.kids = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return x

    for cells in (1, 1 << 20):  # with the lists halved, and with whole tables
        for _ in range(60):
            a, b = tree(3), tree(3)
            a.tag = b.tag = "r"
            shapes = html.Shapes()
            shapes.CELLS = cells
            shapes.mark(a)
            shapes.mark(b)
            assert shapes.match(a.shape, b.shape) == slow(a, b) == len(list(html.pairs(a, b, shapes)))


def plain_article(page):
    """The text of the page's article by a parser of its own, for pages of one article with paragraphs and headings alone."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            self.out += [""] if tag in ("h1", "p", "article") else []
            self.out[-1] += " " if tag == "br" else ""

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            self.out += [""] if tag in ("h1", "p") else []

        def handle_data(self, data):
            self.out[-1] += data if self.inside else ""

    parser = Article()
    parser.feed(page or "")
    parser.close()
    return "\n".join(x for x in (" ".join(t.split()) for t in parser.out) if x)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_op5_query_against_a_parser(spark):
    from hibiki.llm import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op5_html(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages) and all(r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_wrapper_needs_no_lists(spark, monkeypatch):
    """Template and slots alone find the articles of the test pages, hints of words and elements put aside."""
    by = collections.defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        by[r.url.split("/")[2]].append(r.html)
    for name in ("MARKS", "SKIPPED", "LIKELY"):
        monkeypatch.setattr(html, name, frozenset())
    right = total = 0
    for pages in by.values():
        w = html.Wrapper(pages[0], *html.induce(pages[:6]))
        right += sum(w.extract(p) == plain_article(p) for p in pages)
        total += len(pages)
    assert right >= 0.9 * total, (right, total)


@pytest.mark.parametrize("around", ["<div class='layout with-sidebar'>{}</div>", "<body class='search-open'>{}", "{}"])
def test_hints_never_hide_the_article(around):
    rng = random.Random(3)
    pages = [around.format(f"<nav>{prose(rng, 4)}</nav><article class='category-social'><h1>{prose(rng, 3)}</h1><p>{prose(rng, 40)}</p><p>Subscribe to this</p><p class='share'>{prose(rng, 2)}</p></article><footer>{prose(rng, 5)}</footer>") for _ in range(5)]
    for some in (pages, pages[:1]):
        w = html.Wrapper(some[0], *html.induce(some))
        for p in some:
            want = plain_article(p).split("\n")
            assert w.extract(p).split("\n") == (want[:2] if len(some) > 1 else want[:3])  # the line that all pages share is template


def test_deep_and_wide_pages():
    deep = "<body>" + "<div>" * 5_000 + "deep down"
    assert html.Wrapper(deep, *html.induce([deep, deep + "!", deep + "?"])).extract(deep + " here") == "deep down here"
    wide = lambda n: "<body><ul>" + "".join(f"<li>{i}{'<p>x</p>' if i % 7 == n else ''}" for i in range(1_500)) + "</ul>"
    assert html.Wrapper(wide(1), *html.induce([wide(1), wide(2)])).extract(wide(3)).startswith("0\n1\n2\n3\nx")


def test_urls(spark):
    rows = [(1, "http://a.NET/en/1"), (2, "https://x.example.net/en/2"), (3, "http://example.com/de/3"), (4, "http://q.org/fr"), (5, "http://q.org/fr/"), (6, None), (7, "no scheme"), (8, "http://badnet/x"), (9, "http://spam.example.org/p?x=1")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, rule string")
    known = spark.createDataFrame([(f"http://{'spam' if i % 2 else f'fine{i}'}.example.org/p/{i}", i % 2) for i in range(40)], "url string, blocked int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, known).collect()}
    assert got[1] == ("a.net", "/en/1", "net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2:] == (None, "allow")
    assert got[9][3] == "block"
    assert urls.judged(pages.limit(0), known).count() == 0 and urls.judged(pages, known.limit(0)).count() == len(rows)


# -- pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    rng = random.Random(9)
    clean = spark.createDataFrame([(1000 + i, prose(rng, 90), "x", "y", "z") for i in range(5)] + [(1000, None, "x", "y", "z")], docs.schema)
    given = docs.unionByName(clean)
    kept = cp.quality_rules(spark, given, "")
    assert kept.columns == given.columns and {r.doc_id for r in kept.collect()} >= {1001, 1002, 1003, 1004}
    once = cp.simhash_dedup(spark, kept, "")
    ids = [r.doc_id for r in once.collect()]
    assert once.columns == given.columns and ids.count(3) == 1 and {1001, 1002, 1003, 1004} <= set(ids) and 40 not in ids and 41 not in ids
    cut = cp.substring_dedup(spark, once, "")
    assert cut.columns == given.columns and cut.count() == once.count()
    for stage in (cp.quality_rules, cp.simhash_dedup, cp.substring_dedup):
        assert stage(spark, given.limit(0), "").count() == 0
    assert F is not None
