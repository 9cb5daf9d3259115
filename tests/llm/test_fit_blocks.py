"""The latent space of decontamination is factored in blocks, away from the driver."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from hibiki.llm import decontam


def made(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 900)}" for _ in range(rng.choice([0, 3, 60, 150]))) for _ in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(1, "w1 w2 w3 w700 w20"), (2, "never seen words")], "item_id long, text string")


def test_the_fit_never_lies_whole_at_the_driver(spark):
    docs, bench = made(spark)
    decontam.latent(docs, bench)
    tracemalloc.start()
    decontam.latent(docs, bench)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # one table of sums in 64 bits is 33 MB, its factors as much again


def test_blocks_give_the_space_of_the_whole_table(spark):
    docs, bench = made(spark)
    got, idf = decontam.latent(docs, bench)
    df, passages, n = decontam.frequencies(docs)
    whole = np.log((1 + passages) / (1 + df))
    whole[0] = 0
    y = decontam._gram(docs.select("text"), 3, whole) * min(1.0, decontam.AMONG / n) + decontam.ITEM_WEIGHT * decontam._gram(bench.select("text"), 3, whole)
    column, sign = decontam.test_table(3)
    core = np.zeros((y.shape[1], y.shape[1]))
    for k in range(decontam.SIGNS):
        np.add.at(core, column[:, k], sign[:, k, None] * y)
    q, r = np.linalg.qr(y)
    inner = r @ np.linalg.pinv((core + core.T) / 2, 1e-7, hermitian=True) @ r.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    want = whole[:, None] * (q @ vectors[:, np.argsort(-values)[: decontam.DIMS]])
    words = np.flatnonzero(np.abs(y).sum(1))[::5]
    a, b = got[words].astype(np.float64), want[words]
    assert np.allclose(a @ a.T, b @ b.T, atol=0.02 * float((b * b).sum(1).max()))
    assert np.allclose(idf, whole)
