"""Keyed access to token ids."""

import random

import pytest

from hibiki.llm import tokens


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [(i * 7 - 50, " ".join(rng.choice(["alpha", "Beta,", "日本", "émile", "x1"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1 << 40, None), (None, "no key"), (-50, "zz again")]
    out = f"file://{tmp_path_factory.mktemp('tokens')}/t"
    tokens.write_shards(spark.createDataFrame(docs, "doc_id long, text string"), path, out, shards=6)
    t = Tokenizer.from_file(path)
    return out, tokens.write_index(spark, out), {i: [*t.encode(x or "", add_special_tokens=False).ids, tokens.END_ID] for i, x in docs if i is not None and x != "zz again"}, docs


def test_fetch_reads_what_was_encoded(spark, written):
    path, classes, ids, docs = written
    asked = [d[0] for d in docs[:40:3]] + [1 << 40, 5, None, 12_345]
    got = {r.key: r.ids for r in tokens.fetch(spark.createDataFrame([(k,) for k in asked], "key long"), path, classes).collect()}
    assert set(got) == {k for k in asked if k in ids}
    assert all(got[k] == ids[k] for k in got if k != -50)
    whole = {r.key: r.ids for r in tokens.fetch(spark.createDataFrame([(k,) for k in ids], "key long"), path, classes).collect()}
    assert {k: v for k, v in whole.items() if k != -50} == {k: v for k, v in ids.items() if k != -50}
    assert tokens.fetch(spark.createDataFrame([], "key long"), path, classes).collect() == []


def test_fetch_opens_only_the_parts_it_needs(spark, written, monkeypatch):
    path, classes, ids, _ = written
    opened = []
    files = tokens._part_files
    monkeypatch.setattr(tokens, "_part_files", lambda s, p, parts: opened.append(files(s, p, parts)) or opened[-1])
    assert len(tokens.fetch(spark.createDataFrame([(k,) for k in list(ids)[:2]], "key long"), path, classes).collect()) == 2
    assert 1 <= len(opened[0]) <= 2
    monkeypatch.setattr(tokens, "NAMED_PARTS", 1)
    assert len(tokens.fetch(spark.createDataFrame([(k,) for k in ids], "key long"), path, classes).collect()) == len(ids)
