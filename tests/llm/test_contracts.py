"""Cases that earlier versions got wrong: content under hint words, long benchmark items, odd columns in the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from hibiki.llm import decontam, html

FRAME = "<html><body><nav>Home About</nav><div class='page'><article><h1>Title {i}</h1>{body}</article></div><footer>Imprint</footer></body></html>"


def texts_of(bodies):
    pages = [FRAME.format(i=i, body=b) for i, b in enumerate(bodies)]
    w = html.Wrapper(pages[0], *html.induce(pages[:6]))
    return [w.extract(p) for p in pages]


def test_comments_go_however_long_they_are():
    bodies = [f"<p>Story number {i} is short.</p><div class='comments-list'>{'<div class=comment><p>reader %d says a lot and more</p></div>' % i * 40}</div>" for i in range(7)]
    assert texts_of(bodies) == [f"Title {i}\nStory number {i} is short." for i in range(7)]


def test_content_under_words_like_hints_stays():
    bodies = [
        f"<p>First {i}.</p><p class='share-price'>Price {i * 7} today.</p><section class='related-work'><p>Others did {i}.</p></section><menu><li>step {i}</li><li>step {i}b</li></menu><p id='adHoc'>Ad hoc {i}.</p><div class='share-buttons'>Tweet {i}</div><div class='ad'>Buy {i}</div>"
        for i in range(7)
    ]
    assert texts_of(bodies) == [f"Title {i}\nFirst {i}.\nPrice {i * 7} today.\nOthers did {i}.\nstep {i}\nstep {i}b\nAd hoc {i}." for i in range(7)]


def test_names_of_boilerplate():
    for name in ("comments", "comment-list", "post-comments", "adBanner", "cookie_notice", "site-header", "sidebar-2", "social-links"):
        assert html.marked(name), name
    for name in ("share-price", "related-work", "ad-hoc", "content", "", "discussion-of-results", "headline", "story"):
        assert not html.marked(name), name


@pytest.mark.parametrize("depth", [10, 600, 3_000])
def test_template_at_any_depth(depth):
    bodies = ["<div>" * depth + "<p>always the same line</p>" + "</div>" * depth + f"<p>Own words {i} here.</p>" for i in range(7)]
    assert texts_of(bodies) == [f"Title {i}\nOwn words {i} here." for i in range(7)]


def size_of(items: decontam.Items) -> int:
    return sum(x.nbytes for n, x in vars(items).items() if isinstance(x, np.ndarray) and n not in ("vectors", "weight"))


def test_item_tables_grow_with_their_words():
    rng = random.Random(2)
    vectors, idf = np.zeros((decontam.BUCKETS, decontam.DIMS), np.float16), np.ones(decontam.BUCKETS, np.float32)
    long_item = [(1, " ".join(f"w{rng.randrange(50_000)}" for _ in range(100_000)))]
    many = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(60))) for i in range(20_000)]
    assert size_of(decontam.Items(long_item, vectors, idf)) < 20 << 20
    assert size_of(decontam.Items(many, vectors, idf)) < 300 << 20


def test_a_long_item_is_found(spark):
    """An item of 6,000 words, copied whole and with every fifth word changed, beside other texts of its words."""
    rng = random.Random(4)
    voc = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{x}" for x in range(900)]
    item = [rng.choice(voc) for _ in range(6_000)]
    changed = [rng.choice(voc) if k % 5 == 0 else w for k, w in enumerate(item)]
    other = [" ".join(rng.choice(voc) for _ in range(6_500)) for _ in range(3)]
    docs = [(0, " ".join(voc[:500] + item + voc[:300])), (1, " ".join(changed)), *((2 + i, t) for i, t in enumerate(other)), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "  ")], "item_id long, text string")
    got = decontam.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (1, 7)}
    assert {r.doc_id: r.common == 1.0 for r in got} == {0: True, 1: False}


# -- the pipeline ------------------------------------------------------------------------------------


def prose(rng, n):
    voc = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    return " ".join(rng.choice(voc) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    base = [prose(rng, 150) for _ in range(12)]
    passage, item = prose(rng, 60), prose(rng, 30)
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(20, base[0]), (21, base[1] + " extra"), (22, base[2]), (22, base[2])]  # copies, near copies, repeated rows
    docs += [(30, prose(rng, 90) + " " + passage), (31, passage + " " + prose(rng, 90))]  # a shared passage
    docs += [(40, prose(rng, 80) + " " + item + " " + prose(rng, 40)), (41, prose(rng, 130))]
    docs += [(50, "too short"), (51, None), (52, ""), (None, prose(rng, 140)), (None, prose(rng, 140))]
    rows = [(i, t, "en", "src", len(t or ""), {"k": i or 0}, f"d{i}", [1, 2]) for i, t in docs]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m map<string,long>, `a.b` string, best array<int>").write.parquet(f"file://{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{out}/benchmark.parquet")
    return f"file://{out}", dict(docs), passage


def test_stages_one_by_one(spark, tables):
    path, texts, passage = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = corpus_pipeline.stored(out, name)
        kept[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
    first = [0, *range(1, 12)]
    assert kept["quality_rules"] == [*first, 20, 21, 22, 22, 30, 31, 40, 41, None, None]
    assert kept["simhash_dedup"] == [*first, 30, 31, 40, 41, None, None]
    assert kept["substring_dedup"] == kept["simhash_dedup"]
    assert kept["decontamination"] == [*first, 30, 31, 41, None, None]
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    assert all(passage not in r.text for r in rows.values()) and rows[30].n_chars == len(rows[30].text)
    assert rows[3].text == texts[3] and rows[3].m == {"k": 3} and rows[3]["a.b"] == "d3" and rows[3].best == [1, 2]


def test_run_packs_what_is_kept(spark, tables):
    from tokenizers import Tokenizer

    import public_tokenizers

    path, texts, _ = tables
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, path).collect()
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.capacity in (512, 1024, 2048, 4096) and r.bin_offset + r.length <= r.capacity
    assert {i for i in whole if i is not None} == {*range(12), 30, 31, 41}
    for i in (1, 5, 41):
        own = sorted(whole[i])
        assert sum(n for _, n in own) == len(t.encode(texts[i], add_special_tokens=False).ids) + 1 and own[0][0] == 0
    spots = sorted((r.bin_id, r.bin_offset, r.bin_offset + r.length) for r in got)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spots, spots[1:]))


def test_empty_tables(spark, tables):
    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name
