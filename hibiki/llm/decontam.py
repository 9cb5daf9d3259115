"""Benchmark decontamination by latent semantic retrieval.

1. Passage frequencies of hashed words are counted over all documents.
2. A randomised SVD of TF-IDF passages gives DIMS latent directions. Tasks sum A'(A S) over
   the passages of all documents and of the benchmark's items, S a fixed sparse random table.
   One pass tells both the space and its order (Nystroem: A'A is about Y (S'Y)^-1 Y' with
   Y = A'A S). Every passage counts, copies too. Y stays in blocks of rows at the tasks, which
   factor them; the driver joins the blocks' small factors, and gets the word vectors alone.
3. Every document, whole, is cut into half-overlapping windows about as long as an item. Every
   window's latent vector is compared with every item of its length class; those whose cosine,
   as a share of what the item keeps in latent space, is at least COSINE are candidates. No
   window is left out for the words that it holds: the comparison is in latent space alone.
4. A candidate counts if the longest common subsequence of words between the item and the
   text around the window holds COPY of the item's words, or PARAPHRASE of them and ANSWER
   of the words of the item's last sentence.

A window's vector is a sum over short blocks of words, so that each word's vector is read once
for all length classes. Its norm counts every word by itself, which is at most the norm of the
window's counts: the cosine errs upwards, never against a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, stored, summed

BUCKETS, DIMS, EXTRA = 1 << 15, 120, 8
BLOCK = 2048
PASSAGE = 48
#: Random signs of a bucket in the fit's test table, and passages that are summed together.
SIGNS, TILE = 4, 64
#: Weight of an item's passages in the fit, beside the documents' passages with a weight of AMONG documents.
ITEM_WEIGHT, AMONG = 4, 2_000
#: COSINE is what a paraphrase with PARAPHRASE of the item's words keeps in a window that holds rarer words besides.
COSINE, COPY, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.5
#: Items, and words of items, that are searched for in one pass over the documents.
ITEMS, ITEM_WORDS = 20_000, 2_000_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Share of an item's places whose words are looked for first.
RARE = 0.6
#: Window sizes, in words.
SIZES = tuple(sorted({round(6 * 1.4**i) for i in range(26)}))


def _plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION)


def pieces(text: str | None) -> list[bytes]:
    """A text's words: lower case, without ASCII punctuation, which may leave none of a piece."""
    return _plain(text).split()


def word_list(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in pieces(text)]


_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_BASE = 0x9E3779B97F4A7C15
_CHUNK_BYTES = 1 << 20


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as many as the longest chunk needed so far."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    x = np.full(n, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def hashed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all words of a blob, in one pass over its bytes, and the words' places."""
    a = np.frombuffer(blob, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~_BLANK[a]
    turn = np.diff(word)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _Powers.upto(len(a) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32), starts


def buckets_of(h: np.ndarray) -> np.ndarray:
    """Buckets 1 to BUCKETS - 1; 0 is no word."""
    return (h % np.uint32(BUCKETS - 1) + np.uint32(1)).astype(np.int64)


def bucket_array(words: list[bytes]) -> np.ndarray:
    return buckets_of(hashed(b" ".join(words))[0])


def _laid(texts) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Chunks of documents: buckets of their words end to end, sizes, and the number of documents before."""

    def chunk():
        h, at = hashed(b"\n".join(held))
        ends = np.cumsum([len(x) + 1 for x in held])
        sizes = np.diff(np.searchsorted(at, ends), prepend=0)
        return buckets_of(h), sizes, done

    held, size, done = [], 0, 0
    for t in texts:
        x = _plain(t)
        held.append(x)
        size += len(x)
        if size >= _CHUNK_BYTES:
            yield chunk()
            done += len(held)
            held, size = [], 0
    if held:
        yield chunk()


def _passages(sizes: np.ndarray) -> np.ndarray:
    """The passage of each word: PASSAGE words of one document each."""
    starts = np.cumsum(sizes) - sizes
    count = -(-sizes // PASSAGE)
    base = np.cumsum(count) - count
    within = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return np.repeat(base, sizes) + within // PASSAGE


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int, int]:
    """Passages with each bucket, passages and documents, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS), np.zeros(BLOCK)
        for b in batches:
            n[1] += b.num_rows
            for ids, sizes, _ in _laid(b.column(0).to_pylist()):
                if len(ids):
                    of = _passages(sizes)
                    n[0] += of[-1] + 1
                    key = np.sort(of * BUCKETS + ids)
                    df += np.bincount(key[np.r_[True, key[1:] != key[:-1]]] % BUCKETS, minlength=BUCKETS)
        blobs = [x.astype("<f4").tobytes() for x in (*df.reshape(-1, BLOCK), n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "block int, blob binary")
    got = summed(parts, BUCKETS // BLOCK + 1)
    n = got.pop(BUCKETS // BLOCK, np.zeros(2))
    df = np.concatenate([got.get(k, np.zeros(BLOCK)) for k in range(BUCKETS // BLOCK)])
    return df.astype(np.float64), int(n[0]), int(n[1])


def test_table(seed: int, wide: int = DIMS + EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random table, one row a bucket: SIGNS columns of each, and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, wide, (BUCKETS, SIGNS)), rng.choice(np.float32([-1, 1]), (BUCKETS, SIGNS))


def _gram_parts(texts: DataFrame, seed: int, shared, wide: int = DIMS + EXTRA) -> DataFrame:
    """Each task's part of A'(A S), in blocks, for the unit TF-IDF passages A of texts(text), all of them, and the test table S of the seed; shared: the idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (column, sign) = shared.value, test_table(seed, wide)
        out, place = np.zeros((BUCKETS, wide), np.float32), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for ids, sizes, _ in _laid(b.column(0).to_pylist()):
                if not len(ids):
                    continue
                key = np.sort(_passages(sizes) * BUCKETS + ids)
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                row, col = key[new] // BUCKETS, key[new] % BUCKETS
                val = np.diff(np.r_[new, len(key)]) * w[col]
                bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
                norm = np.sqrt(np.add.reduceat(val * val, bounds[:-1]))
                val = (val / np.maximum(np.repeat(norm, np.diff(bounds)), 1e-9)).astype(np.float32)
                for c in range(0, len(bounds) - 1, TILE):  # few passages at a time: their words make a small dense table
                    n = min(TILE, len(bounds) - 1 - c)
                    some = slice(bounds[c], bounds[c + n])
                    own, at = col[some], row[some] - c
                    y = np.bincount((at[:, None] * wide + column[own]).reshape(-1), (sign[own] * val[some, None]).reshape(-1), n * wide)
                    words = np.unique(own)
                    place[words] = np.arange(len(words))
                    dense = np.zeros((n, len(words)), np.float32)
                    dense[at, place[own]] = val[some]
                    out[words] += dense.T @ y.reshape(n, wide).astype(np.float32)
        blobs = [out[i : i + BLOCK].astype("<f4").tobytes() for i in range(0, BUCKETS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blobs), dtype=np.int32)), pa.array(blobs, pa.binary())], ["block", "blob"])

    return texts.mapInArrow(run, "block int, blob binary")


def _gram(texts: DataFrame, seed: int, idf: np.ndarray, wide: int = DIMS + EXTRA) -> np.ndarray:
    """A'(A S) as one table."""
    shared = texts.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    got = summed(_gram_parts(texts, seed, shared, wide), BUCKETS // BLOCK)
    shared.destroy()
    return np.concatenate([got[k].reshape(-1, wide) if k in got else np.zeros((BLOCK, wide)) for k in range(BUCKETS // BLOCK)]).astype(np.float64)


def _directions(y: DataFrame, seed: int, idf: np.ndarray, wide: int = DIMS + EXTRA) -> np.ndarray:
    """Word vectors from the blocks (block, blob) of Y = A'(A S), which never lie in one place: each block is factored by itself, then the blocks' small factors together."""

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield k, np.frombuffer(blob.as_buffer(), "<f4").reshape(-1, wide).astype(np.float64)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, sign = test_table(seed, wide)
        for b in batches:
            for k, part in opened(b):
                own, core = slice(k * BLOCK, (k + 1) * BLOCK), np.zeros((wide, wide))
                for i in range(SIGNS):
                    np.add.at(core, column[own, i], sign[own, i, None] * part)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (core, np.linalg.qr(part, "r")))], ["block", "core", "r"])

    told = sorted(y.mapInArrow(factors, "block int, core binary, r binary").collect())
    core = sum((np.frombuffer(t.core).reshape(wide, wide) for t in told), np.zeros((wide, wide)))
    q, r = np.linalg.qr(np.concatenate([np.frombuffer(t.r).reshape(wide, wide) for t in told]))
    inner = r @ np.linalg.pinv((core + core.T) / 2, 1e-7, hermitian=True) @ r.T
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = vectors[:, np.argsort(-values)[:DIMS]]
    turns = {t.block: q[i * wide : (i + 1) * wide] @ best for i, t in enumerate(told)}
    shared = y.sparkSession.sparkContext.broadcast((idf, turns))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, turns = shared.value
        for b in batches:
            for k, part in opened(b):
                x = idf[k * BLOCK : (k + 1) * BLOCK, None] * (np.linalg.qr(part)[0] @ turns[k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype("<f2").tobytes()], pa.binary())], ["block", "blob"])

    out = np.zeros((BUCKETS, DIMS), np.float16)
    for t in y.mapInArrow(turned, "block int, blob binary").collect():
        out[t.block * BLOCK : (t.block + 1) * BLOCK] = np.frombuffer(t.blob, "<f2").reshape(-1, DIMS)
    shared.destroy()
    return out


def latent(docs: DataFrame, bench: DataFrame, text_col: str = "text", seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors (idf times the right singular vectors of all passages, one row a bucket), and idf."""
    df, passages, n = frequencies(docs, text_col)
    idf = np.log((1 + passages) / (1 + df))
    idf[0] = 0
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))
    weighed = [(docs.select(F.col(text_col).cast("string").alias("text")), min(1.0, AMONG / max(1, n))), (bench.select("text"), float(ITEM_WEIGHT))]
    parts = [_gram_parts(texts, seed, shared).withColumn("times", F.lit(times)) for texts, times in weighed]
    y = stored(added(parts[0].unionByName(parts[1]), BUCKETS // BLOCK), "gram")
    shared.destroy()
    return _directions(y, seed, idf), idf.astype(np.float32)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a's positions as the bits of one number."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def last_sentence(words_of: str) -> list[str]:
    parts = [p for p in re.split(r"[.!?\n]+", words_of) if word_list(p)]
    return word_list(parts[-1]) if parts else []


def window_size(n: int) -> int:
    """The window for an item of n words: the size nearest to n, as a ratio."""
    return min(SIZES, key=lambda s: max(s / n, n / s))


class Items:
    """A block of items, by window size."""

    def __init__(self, rows: list[tuple[int, str]], vectors: np.ndarray, idf: np.ndarray):
        self.vectors, self.weight = vectors, (idf * idf).astype(np.float32)
        by: dict[int, list[int]] = {}
        self.ids, self.words, self.answers, queries = [], [], [], []
        for item_id, text in rows:
            words_ = word_list(text)
            if not words_:
                continue
            buckets = bucket_array(pieces(text))
            v = vectors[buckets].astype(np.float32).sum(0)
            norm = max(float(np.linalg.norm(v)), 1e-9)
            # so that a window that is the item's copy scores 1: divided by what the item keeps, and by the window's full norm
            kept = norm / max(float(np.sqrt(self.weight[buckets].sum())), 1e-9)
            by.setdefault(window_size(len(words_)), []).append(len(self.ids))
            self.ids.append(item_id)
            self.words.append(words_)
            self.answers.append(last_sentence(text))
            queries.append(v / norm / max(kept, 1e-9))
        #: Words of a block, and of each class the blocks that make half a window, its items and their vectors.
        self.fine = max(1, min(by, default=4) // 4)
        self.by = [(max(1, round(size / 2 / self.fine)), np.array(ks), np.array([queries[k] for k in ks], np.float32)) for size, ks in sorted(by.items())]
        self.lengths = np.array(list(map(len, self.words)), np.int64)
        # Of each item the buckets of its rarest places, RARE of them: a subsequence of PARAPHRASE takes `need` words from them at least.
        self.need, owners = np.zeros(len(self.words), np.int64), []
        for k, w in enumerate(self.words):
            own = bucket_array([x.encode("utf-8", "surrogatepass") for x in w])
            rare = np.unique(own[np.argsort(self.weight[own], kind="stable")[len(own) - int(np.ceil(RARE * len(own))) :]])
            self.need[k] = np.ceil(PARAPHRASE * len(own) - 1e-9) - (~np.isin(own, rare)).sum()
            owners.append(rare)
        which = np.repeat(np.arange(len(owners)), list(map(len, owners)))
        buckets = np.concatenate([np.zeros(0, np.int64), *owners])
        self.owner = which[np.argsort(buckets, kind="stable")]
        self.owned = np.cumsum(np.bincount(buckets + 1, minlength=BUCKETS + 1))
        # (item, bucket) of every word of an item, in order, and how many of the item's places have it: as much as the items' words
        own = [bucket_array([x.encode("utf-8", "surrogatepass") for x in w]).astype(np.int64) + k * BUCKETS for k, w in enumerate(self.words)]
        self.held, self.times = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)

    def candidates(self, ids: np.ndarray, sizes: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of documents, items, window starts, window ends and cosines, for one chunk of buckets."""
        if self.vectors.dtype != np.float32:
            self.vectors = self.vectors.astype(np.float32)  # once a worker
        if not len(ids):
            return
        fine = self.fine
        blocks = -(-sizes // fine)
        first = np.cumsum(blocks) - blocks
        laid = np.zeros(int(blocks.sum()) * fine, np.int64)  # every document padded to whole blocks with bucket 0, which weighs nothing
        laid[np.repeat(first * fine - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        laid = laid.reshape(-1, fine)
        n = len(laid)
        run, weight = np.zeros((1 + -(-n // 8) * 8, self.vectors.shape[1]), np.float32), np.zeros(n + 1)
        v = run[1:]
        w = np.zeros(n)
        for c in range(0, n, 2048):  # tiles that stay in the cache
            part = laid[c : c + 2048]
            x = self.vectors[part[:, 0]]
            for i in range(1, fine):
                x += self.vectors[part[:, i]]
            v[c : c + len(part)] = x
        for i in range(fine):
            w += self.weight[laid[:, i]]
        np.cumsum(w, out=weight[1:])
        # running sums: within groups of eight blocks, then over the groups
        eight = v.reshape(-1, 8, v.shape[1])
        for i in range(1, 8):
            eight[:, i] += eight[:, i - 1]
        before = np.cumsum(eight[:, 7], axis=0)
        eight[1:] += before[:-1, None]
        for half, ks, items in self.by:
            # every half window's bounds; a window runs from one bound to the next but one
            halves = -(-blocks // half)
            count = np.where(blocks > 0, halves + 1, 0)
            doc = np.repeat(np.arange(len(sizes)), count)
            at = np.minimum((np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * half, blocks[doc])
            made = run[first[doc] + at] @ items.T
            bound = weight[first[doc] + at]
            begins = at < np.where(halves > 1, (halves - 1) * half, 1)[doc]
            x = np.flatnonzero(begins)
            y = x + np.where(halves > 1, 2, 1)[doc[x]]
            norm = np.sqrt(np.maximum(bound[y] - bound[x], 1e-12)).astype(np.float32)
            got = made[y] - made[x]
            hit = np.flatnonzero(got >= (cosine * norm)[:, None])
            if len(hit):
                i, j = hit // len(ks), hit % len(ks)
                d = doc[x[i]]
                yield d, ks[j], at[x[i]] * fine, np.minimum(at[y[i]] * fine, sizes[d]), got.reshape(-1)[hit] / norm[i]

    def possible(self, ids: np.ndarray, sizes: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, start, end, cosine) of candidates whose surroundings hold the words of enough of the item's places for PARAPHRASE, in whatever order: a bound that the subsequence cannot pass."""
        starts = np.cumsum(sizes) - sizes
        times = self.owned[ids + 1] - self.owned[ids]
        rare = np.flatnonzero(times)
        times = times[rare]
        order = np.repeat(self.owned[ids[rare]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        spots = np.sort(self.owner[order] * (len(ids) + 1) + np.repeat(rare, times))  # (item, place) of every rare word of an item
        for d, k, x, y, score in self.candidates(ids, sizes, cosine):
            half = self.lengths[k] // 2
            lo, hi = np.maximum(x - half, 0), np.minimum(y + half, sizes[d])
            base = k * (len(ids) + 1) + starts[d]
            some = np.flatnonzero(np.searchsorted(spots, base + hi) - np.searchsorted(spots, base + lo) >= self.need[k])
            if not len(some):
                continue
            d, k, lo, hi, score = d[some], k[some], lo[some], hi[some], score[some]
            n = hi - lo
            first = np.cumsum(n) - n
            asked = np.repeat(k, n) * BUCKETS + ids[np.repeat(starts[d] + lo - first, n) + np.arange(int(n.sum()))]
            at = np.minimum(np.searchsorted(self.held, asked), len(self.held) - 1)
            hit = np.flatnonzero(self.held[at] == asked)
            # each of an item's words once for a window
            met = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(self.held) + at[hit])
            there = np.bincount(met // len(self.held), self.times[met % len(self.held)], len(n))
            enough = there >= PARAPHRASE * self.lengths[k] - 1e-9
            for i in np.flatnonzero(enough).tolist():
                yield int(d[i]), int(k[i]), int(lo[i]), int(hi[i]), float(score[i])


FOUND = "doc_id long, item_id long, cosine double, common double, answer double, start int, end int, seal long"


def seal_of(text):
    """The hash by which a row's text is told from other texts of the same id; of null as of an empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def search(docs: DataFrame, rows: list[tuple[int, str]], space: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """Accepted (doc_id, item_id, cosine, common, answer, start, end) for one block of items; start and end count words with a letter or digit; seal: the text's hash, since ids may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(Items(rows, *space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            out, texts = [], b.column(1).to_pylist()
            for ids, sizes, done in _laid(texts):
                spots: dict[tuple[int, int], list] = {}
                for d, k, lo, hi, c in items.possible(ids, sizes, cosine):
                    spots.setdefault((d, k), []).append((c, lo, hi))
                split: dict[int, list[str]] = {}
                for (d, k), near_ in spots.items():
                    if d not in split:
                        split[d] = word_list(texts[done + d])
                    best = None
                    want, answer = items.words[k], items.answers[k]
                    for c, lo, hi in sorted(near_, reverse=True):
                        if best and best[0] == 1.0:  # the whole item is there: no window can tell more
                            break
                        near = split[d][lo:hi]
                        common = common_words(want, near) / len(want)
                        if common < PARAPHRASE:
                            continue
                        said = common_words(answer, near) / max(1, len(answer))
                        if common >= COPY or said >= ANSWER:
                            best = max(best or (-1.0,), (common, said, c, lo, hi))
                    if best:
                        out.append((b.column(0)[done + d].as_py(), items.ids[k], best[2], best[0], best[1], best[3], best[4], b.column(2)[done + d].as_py()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "cosine", "common", "answer", "start", "end", "seal"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("d"), text.alias("t"), seal_of(text).alias("s")).mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """One row for every pair of a document and a benchmark item that it holds, copied or paraphrased.

    Null and blank texts hold nothing, null and blank items are not searched for; items with
    equal ids are searched for one by one; repeated documents give repeated rows; without items
    or documents there are no rows; other columns are ignored.
    """
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.trim("text") != "")
    n, words_ = bench.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()
    if not n:
        return docs.sparkSession.createDataFrame([], FOUND)
    space = latent(docs, bench, text_col)
    blocks, out = max(-(-n // ITEMS), -(-words_ // ITEM_WORDS)), None
    for k in range(blocks):
        some = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        found = search(docs, [tuple(r) for r in some.collect()], space, id_col, text_col, cosine)
        out = found if out is None else out.unionByName(found)
    return out
