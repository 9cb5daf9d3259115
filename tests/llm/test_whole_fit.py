"""The latent space of decontamination over all documents."""

from __future__ import annotations

import random

import numpy as np

from hibiki.llm import decontam


def test_latent_space_is_fitted_on_all_documents(spark):
    """Words that meet only in documents outside one hash class of 2,000 share a direction, since no document is left out of the fit."""
    rng = random.Random(8)
    texts = [" ".join(rng.sample([f"common{k}" for k in range(60)], 12)) + f" own{i}" for i in range(5_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    outside = [r.doc_id for r in df.where("pmod(xxhash64(concat(text, ' ember falcon')), 3) <> 0").select("doc_id").sort("doc_id").limit(150).collect()]
    texts = [t + " ember falcon" * (i in outside) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, "common1 common2 common3 common4")], "item_id long, text string")
    vectors, idf = decontam.latent(docs, bench)
    a, b = (vectors[decontam.bucket_array([w])[0]].astype(float) for w in (b"ember", b"falcon"))
    assert a @ b > 0.9 * np.linalg.norm(a) * np.linalg.norm(b) and np.linalg.norm(a) > 0.5 * idf[decontam.bucket_array([b"ember"])[0]] / 2**0.5


def test_passage_sums_equal_plain_ones(spark):
    """A'(A S) over all rows, repeated and null ones too, against a table of all passages."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 47, 48, 49, 200]))) for _ in range(150)] + [None, "", "same text"] + ["same text"] * 70
    idf = np.random.default_rng(2).uniform(1, 6, decontam.BUCKETS)
    got = decontam._gram(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 5, idf)
    rows = []
    for t in texts:
        words = (t or "").split()
        for c in range(0, len(words), decontam.PASSAGE):
            row = np.zeros(decontam.BUCKETS)
            np.add.at(row, decontam.bucket_array([w.encode() for w in words[c : c + decontam.PASSAGE]]), 1)
            row *= idf
            rows.append(row / np.linalg.norm(row))
    a = np.array(rows)
    column, sign = decontam.test_table(5)
    s = np.zeros((decontam.BUCKETS, got.shape[1]))
    for k in range(decontam.SIGNS):
        np.add.at(s, (np.arange(len(s)), column[:, k]), sign[:, k])
    assert np.allclose(got, a.T @ (a @ s), atol=1e-4)
