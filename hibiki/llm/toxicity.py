"""Toxicity: a linear-chain conditional random field over words, summed up for documents.

Token labels come from document labels: a feature of a word (the word, or one of its prefixes)
that is far more frequent in toxic than in other labelled documents marks its words in toxic
documents. The field has two states; its features are the word, its prefixes and ending, and
the words beside it, hashed. Forward-backward marginals give each word's probability; their
sum, largest and share are a document's features for a final logistic fit, and the words above
one half are its offending offsets.

Both fits use at most `sample_rows` labelled rows, lowest hash of the id first; counts for the
token labels are taken over the same rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows learned from, at most; of them, rows whose words train the field.
SAMPLE_ROWS, FIELD_ROWS = 20_000, 2_500
HASHED = 1 << 16
PREFIXES = (4, 5, 6, 7)
_CACHE = 300_000
_CHUNK_WORDS = 200_000
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…"
_PIECE = re.compile(r"\S+")
_STEP = 64


def core(piece: str) -> str:
    return piece.strip(_STRIP).lower()


def traits(word: str) -> list[str]:
    """The features that token labels are drawn from."""
    return [f"w={word}", *(f"p={word[:n]}" for n in PREFIXES if len(word) > n)] if word else []


def _slot(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 3) % HASHED


class Words(dict):
    """From a piece of text to its number; tables hold, by number, the hashed features of it and of it as a neighbour."""

    def __init__(self, weights: np.ndarray | None = None, marked: set[str] = frozenset()):
        super().__init__()
        self.weights, self.marked = None if weights is None else weights.tolist(), marked
        self.own: list[list[int]] = []
        self.side: list[tuple[int, int]] = []
        self.scores = array("d")  # three numbers a word: its own score, and what it adds to the words after and before it
        self.hits: list[bool] = []

    def __missing__(self, piece: str) -> int:
        w = core(piece)
        own = [_slot(f) for f in traits(w)] + ([_slot("s=" + w[-3:])] if w else [])
        before, after = _slot("b=" + w), _slot("a=" + w)
        self[piece] = n = len(self.hits)
        self.hits.append(bool(self.marked) and any(f in self.marked for f in traits(w)))
        if self.weights is None:
            self.own.append(own)
            self.side.append((before, after))
        else:
            w = self.weights
            self.scores.extend((sum([w[i] for i in own]), w[before], w[after]))
        return n


def scan(ratio: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward vectors of chains laid end to end.

    ratio: potential of state 1 over state 0; first: where a chain begins; step[i, j]: weight of
    going from i to j; start: weights of a chain's first state. Blocks of _STEP words run side by
    side: first as 2 x 2 products, then again from the vectors that enter them.
    """
    n = len(ratio)
    blocks = max(1, -(-n // _STEP))
    r = np.ones(blocks * _STEP)
    r[:n] = ratio
    f = np.zeros(blocks * _STEP, bool)
    f[:n] = first
    r, f = r.reshape(blocks, _STEP).T.copy(), f.reshape(blocks, _STEP).T.copy()
    (t00, t01), (t10, t11) = step

    def move(a, b, i):
        s = a + b
        x = np.where(f[i], s * start[0], a * t00 + b * t10)
        y = np.where(f[i], s * start[1], a * t01 + b * t11) * r[i]
        return x, y

    one, zero = np.ones(blocks), np.zeros(blocks)
    a, b, c, d = one, zero, zero, one
    for i in range(_STEP):
        a, b = move(a, b, i)
        c, d = move(c, d, i)
        z = 1 / (a + b + c + d)
        a, b, c, d = a * z, b * z, c * z, d * z
    va, vb = np.empty(blocks), np.empty(blocks)
    x, y = 0.5, 0.5
    for k, (p, q, u, v) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        va[k], vb[k] = x, y
        x, y = x * p + y * u, x * q + y * v
        s = x + y
        x, y = x / s, y / s
    out = np.empty((_STEP, blocks, 2))
    for i in range(_STEP):
        va, vb = move(va, vb, i)
        z = 1 / (va + vb)
        va, vb = va * z, vb * z
        out[i, :, 0], out[i, :, 1] = va, vb
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(logit: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Each word's probability of state 1, and the forward and backward vectors."""
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    first, last = np.zeros(len(logit), bool), np.zeros(len(logit), bool)
    first[ends - sizes] = True
    last[ends - 1] = True
    ratio = np.exp(np.clip(logit, -30, 30))
    fwd = scan(ratio, first, step, start)
    back = scan(ratio[::-1], last[::-1], step.T, np.ones(2))[::-1]
    both = fwd * back / np.stack([np.ones(len(ratio)), ratio], 1)
    return both[:, 1] / np.maximum(both.sum(1), 1e-300), fwd, back


class Field:
    def __init__(self):
        self.weights = np.zeros(HASHED)
        self.bias = -4.0
        self.step = np.log(np.array([[0.98, 0.02], [0.6, 0.4]]))
        self.start = np.log(np.array([0.98, 0.02]))

    def fit(self, docs: list[tuple[list[int], list[bool]]], words: Words, rounds: int = 12, rate: float = 0.4) -> Field:
        """docs: each one's word numbers and labels. Adagrad on the exact gradient of the conditional likelihood, by batches of documents."""
        rng = np.random.default_rng(1)
        grown, grown_t = np.full(HASHED, 1e-2), [1.0, np.ones((2, 2))]
        docs = [d for d in docs if d[0]]
        own_at = np.cumsum([0, *map(len, words.own)])
        own = np.array([x for o in words.own for x in o], np.int64)
        side = np.array(words.side, np.int64).reshape(-1, 2)
        for _ in range(rounds if docs else 0):
            for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 200)):
                ids = np.concatenate([docs[i][0] for i in part])
                y = np.concatenate([docs[i][1] for i in part]).astype(float)
                sizes = np.array([len(docs[i][0]) for i in part])
                take, slots = self._features(ids, sizes, own_at, own, side)
                logit = np.bincount(take, self.weights[slots], len(ids)) + self.bias
                p, fwd, back = marginals(logit, sizes, np.exp(self.step), np.exp(self.start))
                g = p - y
                grad = np.bincount(slots, g[take], HASHED) + 0.01 * self.weights
                grown += grad * grad
                self.weights -= rate * grad / np.sqrt(grown)
                grown_t[0] += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(grown_t[0])
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(sizes) - sizes] = False
                at = np.flatnonzero(inner)
                pair = fwd[at - 1][:, :, None] * np.exp(self.step)[None] * back[at][:, None, :]
                pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
                real = np.zeros((2, 2))
                np.add.at(real, (y[at - 1].astype(int), y[at].astype(int)), 1)
                gt = pair.sum(0) - real
                grown_t[1] += gt * gt
                self.step -= rate * gt / np.sqrt(grown_t[1])
        return self

    @staticmethod
    def _features(ids, sizes, own_at, own, side):
        n = len(ids)
        count = own_at[ids + 1] - own_at[ids]
        take = np.repeat(np.arange(n), count)
        slots = own[np.repeat(own_at[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        near = np.flatnonzero(doc[1:] == doc[:-1])
        return np.concatenate([take, near + 1, near]), np.concatenate([slots, side[ids[near], 0], side[ids[near + 1], 1]])


def _laid(texts, words: Words) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    held, sizes, n, ids = [], [], 0, []
    for t in texts:
        pieces = (t or "").lower().split()  # as many pieces as the text itself has
        ids += map(words.__getitem__, pieces)
        held.append(t)
        sizes.append(len(pieces))
        n += len(pieces)
        if n >= _CHUNK_WORDS:
            yield held, np.array(ids, np.int64), np.array(sizes)
            held, sizes, n, ids = [], [], 0, []
            if len(words) > _CACHE:
                words.clear()
                del words.scores[:]
                words.hits.clear()
    if held:
        yield held, np.array(ids, np.int64), np.array(sizes)


def judge(texts, field: Field, words: Words) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Chunks of texts: the texts, their words' marginals end to end, and their sizes."""
    step, start = np.exp(field.step), np.exp(field.start)
    for held, ids, sizes in _laid(texts, words):
        if not len(ids):
            yield held, np.zeros(0), sizes
            continue
        table = np.array(words.scores).reshape(-1, 3)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        logit = table[ids, 0] + field.bias
        near = np.flatnonzero(doc[1:] == doc[:-1])
        logit[near + 1] += table[ids[near], 1]
        logit[near] += table[ids[near + 1], 2]
        yield held, marginals(logit, sizes, step, start)[0], sizes


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document: log of the expected toxic words, the largest marginal, its two largest together, and the share."""
    out = np.zeros((len(sizes), 4))
    for i, (a, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist())):
        if n:
            q = p[a : a + n]
            top = q.max()
            two = np.partition(q, n - 2)[-2] if n > 1 else 0.0
            out[i] = np.log1p(q.sum()), top, two, np.sqrt(q.sum() / n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with a small ridge; without two classes, the prior alone."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(x.shape[1]), float(np.log(p / (1 - p)))
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 0.1 * w)
    return w[:-1], float(w[-1])


def _chosen(labels: DataFrame, target: str, rows: int) -> DataFrame:
    known = labels.where(F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def marks(rows: DataFrame, least: int = 6, ratio: float = 12.0) -> set[str]:
    """Features in at least `least` toxic texts of rows(text, y), and `ratio` times as frequent there as in others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, other, known = Counter(), Counter(), {}
        n = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y] += 1
                seen = set()
                for piece in set((t or "").split()):
                    got = known.get(piece)
                    if got is None:
                        if len(known) > _CACHE:
                            known.clear()
                        got = known[piece] = traits(core(piece))
                    seen.update(got)
                (toxic if y else other).update(seen)
        keys = [*toxic, *(k for k in other if k not in toxic), ""]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*(toxic[k] for k in keys[:-1]), n[1]], pa.int64()), pa.array([*(other[k] for k in keys[:-1]), n[0]], pa.int64())], ["f", "t", "o"])

    sums = rows.select("text", F.col("y").cast("int")).mapInArrow(count, "f string, t long, o long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    got = {r.f: (r.t, r.o) for r in sums.where((F.col("f") == "") | ((F.col("t") >= least) & (F.col("t") * 2 > F.col("o")))).collect()}
    nt, no = got.pop("", (0, 0))
    return {f for f, (t, o) in got.items() if t / max(nt, 1) > ratio * (o + 0.5) / max(no, 1)}


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = SAMPLE_ROWS, field_rows: int = FIELD_ROWS) -> tuple[Field, np.ndarray, float]:
    """The field, and weights and bias of the documents' logistic, from labels(doc_id, target)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(_chosen(labels, target, sample_rows)), "doc_id")
    marked = marks(rows)
    few = texts.join(F.broadcast(_chosen(labels, target, field_rows)), "doc_id")
    words = Words(marked=marked)
    train = []
    for r in sorted(few.select("doc_id", "text", "y").collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [words[x] for x in (r.text or "").split()]
        train.append((ids, [bool(r.y) and words.hits[i] for i in ids]))
    field = Field().fit(train, words)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        known = Words(f.weights)
        for b in batches:
            x = np.concatenate([summary(p, sizes) for _, p, sizes in judge(b.column(1).to_pylist(), f, known)] or [np.zeros((0, 4))])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int32()), *(pa.array(c) for c in x.T.copy())], ["doc_id", "y", "a", "b", "c", "d"])

    got = sorted(tuple(r) for r in rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, a double, b double, c double, d double").collect())
    x = np.array([r[2:] for r in got]).reshape(len(got), 4)
    return field, *logistic(x, np.array([r[1] for r in got], float))


SCORED = "doc_id long, score double, spans array<struct<start:int,end:int>>"


def score(docs: DataFrame, field: Field, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score, spans) of every row; spans: code-point offsets [start, end) of words with a marginal over one half.

    Null and blank texts get the score of a text without toxic words; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field, weights, bias))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w, c = shared.value
        known = Words(f.weights)
        for b in batches:
            scores, spans = [], []
            for held, p, sizes in judge(b.column(1).to_pylist(), f, known):
                scores.append(1 / (1 + np.exp(-np.clip(summary(p, sizes) @ w + c, -30, 30))))
                at = 0
                for t, n in zip(held, sizes.tolist()):
                    bad = np.flatnonzero(p[at : at + n] > 0.5)
                    found = list(_PIECE.finditer(t)) if len(bad) else []
                    spans.append([{"start": found[i].start(), "end": found[i].end()} for i in bad.tolist()])
                    at += n
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, span)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)


def scored(docs: DataFrame, labels: DataFrame, target: str = "toxic", parts: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, spans) of every row; rows whose crc32 of the id as text leaves `held` modulo `parts` are never learned from.

    Without usable labels every score is the same prior. Repeated rows get equal scores; a row
    with a null id is scored and is not held out; an empty table gives no rows.
    """

    def out(c):
        return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string")), F.lit(parts)) == held, F.lit(False))

    model = fit(docs, labels.where(~out("doc_id")), target)
    return score(docs, *model).select("doc_id", out("doc_id").alias("held_out"), "score", "spans")
