"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

1. Every document of the corpus adds to its words' vectors: a word gains the sparse random
   index vector of each neighbour within WINDOW words. Words and writing marks (capitals,
   symbols, repeats) are hashed to BUCKETS rows; tasks sum a table of fixed size each, and the
   tables are summed by block.
2. A document is the mean of its unit word vectors, plain and weighted by rarity, and the log
   of its length.
3. A two-layer network is fitted on at most `sample_rows` labelled rows, lowest hash of the id
   first, and its logits are divided by a temperature fitted on a fifth of them kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import summed

BUCKETS, DIM, WINDOW = 1 << 14, 32, 2
BLOCK = 512
#: Labelled rows that the network is fitted on, at most.
SAMPLE_ROWS = 20_000
_CACHE = 400_000
_CHUNK_WORDS = 200_000
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _bucket(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 7) % BUCKETS


class Tokens(dict):
    """From a blank-separated piece of text to the buckets of its word and its marks."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        core = piece.strip(_STRIP)
        out = [_bucket("w" + core.lower())] if core else []
        if len(core) > 1 and core.isupper():
            out.append(_bucket("m^"))
        for mark in sorted({c for c in piece if c in _STRIP and c not in ".,"}):
            out.append(_bucket("m" + mark))
        if any(c.isdigit() for c in core):
            out.append(_bucket("m0"))
        self[piece] = got = tuple(out)
        return got


_REPEAT, _LINE = _bucket("m=="), _bucket("m\n\n")


def buckets(text: str | None, known: Tokens) -> list[int]:
    """The buckets of a text, in order; a piece equal to the one before it and a line equal to an earlier one count as marks."""
    if not text:
        return []
    pieces = text.split()
    out = list(chain.from_iterable(map(known.__getitem__, pieces)))
    same = sum(map(str.__eq__, pieces, pieces[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return out + [_REPEAT] * same + [_LINE] * (len(lines) - len(set(lines)))


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions and two signs of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (2, BUCKETS)), rng.choice([-1.0, 1.0], (2, BUCKETS))


def _laid(texts, known: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of documents: their buckets end to end, and each document's size."""
    held, sizes, n = [], [], 0
    for t in texts:
        b = buckets(t, known)
        held.append(b)
        sizes.append(len(b))
        n += len(b)
        if n >= _CHUNK_WORDS:
            yield np.fromiter(chain.from_iterable(held), np.int64, n), np.array(sizes)
            held, sizes, n = [], [], 0
    if held:
        yield np.fromiter(chain.from_iterable(held), np.int64, n), np.array(sizes)


def corpus_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Summed context vectors (BUCKETS x DIM) and counts of all buckets, over all documents."""
    dims, signs = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, counts = Tokens(), np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
        for b in batches:
            for ids, sizes in _laid(b.column(0).to_pylist(), known):
                counts += np.bincount(ids, minlength=BUCKETS)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                at, val = [], []
                for o in range(1, WINDOW + 1):
                    both = doc[o:] == doc[:-o]
                    x, y = ids[:-o][both], ids[o:][both]
                    for u, v in ((x, y), (y, x)):
                        for k in (0, 1):
                            at.append(u * DIM + dims[k][v])
                            val.append(signs[k][v])
                if at:
                    sums += np.bincount(np.concatenate(at), np.concatenate(val), BUCKETS * DIM)
        table = np.concatenate([sums.reshape(BUCKETS, DIM), counts[:, None]], 1).astype("<f4")
        blobs = [table[i : i + BLOCK].tobytes() for i in range(0, BUCKETS, BLOCK)]
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(gather, "block int, blob binary")
    table = np.zeros((BUCKETS, DIM + 1))
    for k, x in summed(parts, BUCKETS // BLOCK).items():
        table[k * BLOCK : (k + 1) * BLOCK] = x.reshape(-1, DIM + 1)
    return table[:, :DIM], table[:, DIM]


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit word vectors, of context less the corpus mean, and own index; with the rarity weight as last column."""
    dims, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    for k in (0, 1):
        own[np.arange(BUCKETS), dims[k]] += signs[k]
    total = max(counts.sum(), 1.0)
    context = sums / np.maximum(counts, 1)[:, None] - sums.sum(0) / total
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    v = norm(norm(context) + norm(own))
    rare = 1e-3 / (1e-3 + counts / total)
    return np.concatenate([v, rare[:, None]], 1).astype(np.float32)


def pooled(texts, vectors: np.ndarray, known: Tokens) -> np.ndarray:
    """One row of features for each text."""
    rows = []
    for ids, sizes in _laid(texts, known):
        full = np.flatnonzero(sizes)
        out = np.zeros((len(sizes), 2 * DIM + 1), np.float32)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            v = vectors[ids]
            out[full, :DIM] = np.add.reduceat(v[:, :DIM], starts) / sizes[full, None]
            w = v[:, DIM:]
            out[full, DIM:-1] = np.add.reduceat(v[:, :DIM] * w, starts) / (np.add.reduceat(w, starts) + 1e-6)
        out[:, -1] = np.log1p(sizes) / 5
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, 2 * DIM + 1), np.float32)


class Network:
    """Two layers on standardised features, with a temperature."""

    def __init__(self, hidden: int = 32, seed: int = 5):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0
        self.prior: float | None = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3) -> Network:
        if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
            self.prior = float((y.sum() + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        cut = len(y) // 5
        hold, train = order[:cut], order[cut:]
        self.mean, self.std = x[train].mean(0), x[train].std(0) + 1e-3
        x = (x - self.mean) / self.std
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
                h = np.tanh(x[idx] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[idx]) / len(idx)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [x[idx].T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ e + 1e-4 * self.p[2], np.array([e.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(hold):
            z, t = self._logit(x[hold]), y[hold]
            loss = lambda c: np.mean(np.logaddexp(0, z / c) - t * z / c)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self._logit((x - self.mean) / self.std) / self.temperature))


def fit(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs, and a network for labels(doc_id, target), fitted on the labelled rows with the lowest hashes."""
    vectors = word_vectors(*corpus_vectors(docs))
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Tokens()
        for b in batches:
            x = pooled(b.column(1).to_pylist(), shared.value, words)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], ["doc_id", "y", "x"])

    got = sorted((r.doc_id, r.y, bytes(r.x)) for r in rows.mapInArrow(run, "doc_id long, y int, x binary").collect())
    x = np.array([np.frombuffer(r[2], "<f4") for r in got], np.float64).reshape(len(got), 2 * DIM + 1)
    return vectors, Network().fit(x, np.array([r[1] for r in got], np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """(doc_id, score) of every row. Null and blank texts get the network's answer to an empty text; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (vecs, model) = Tokens(), shared.value
        for b in batches:
            s = model.score(pooled(b.column(1).to_pylist(), vecs, words))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, target: str = "quality", parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score) of every row; rows whose crc32 of the id as text leaves `held` modulo `parts` are never learned from.

    Without usable labels every score is the same prior. Repeated rows get equal scores; a row
    with a null id is scored and is not held out; an empty table gives no rows.
    """

    def out(c):
        return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string")), F.lit(parts)) == held, F.lit(False))

    vectors, net = fit(docs, labels.where(~out("doc_id")), target)
    return score(docs, vectors, net).select("doc_id", out("doc_id").alias("held_out"), "score")
