"""Removal of long repeated passages, through a compacted sparse de Bruijn graph of the corpus.

Nodes are the k-mers of words that are the minimum of some window's k-mers, so every WINDOW
consecutive words hold at least one node, and equal windows hold the same one. The stretch from
one node to the next is an edge, named by the hash of its words. A node that occurs twice or
more and has one edge in and one edge out, wherever it occurs, is on a nonbranching path: the
words from its predecessor to its successor repeat as a whole. Joins bring every node's counts
to its coordinates; consecutive nonbranching nodes of a document compact into one repeated
span, whose windows are accepted as they are. Windows at path ends and branches, whose node
repeats, are verified one by one: by two hashes of all their words, 96 bits together, counted
over the corpus. A path's outermost nodes are not plain themselves, so a window of theirs that is
accepted in one document may be verified in another; accepted ones of such nodes are counted, too.

What hashes may get wrong: a window of a path is accepted if a node and an edge beside it agree
with another place's, 128 bits, and any other window by 96 bits, so among 10^13 distinct windows
fewer than 0.001 wrong pairs are to be expected.

A hash that holds more than 1 in HOT of the rows goes to a broadcast join, as there are fewer than
HOT such hashes at any size of input; the other hashes shuffle.

Rows are told apart by (doc_id, hash of text), so repeated rows count as copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

WINDOW = 35
K = 8
START, END = 0, 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHECK_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_CHECK_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
#: A hash is hot if it holds more than 1 in HOT of the rows that repeated hashes hold.
HOT = 2048
#: Words that are hashed together in one array.
_CHUNK_WORDS = 400_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at just the six ASCII blanks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of word spans of one or more documents laid end to end."""

    def __init__(self, docs: list[list[bytes]], window: int = WINDOW, k: int = K):
        self.k, self.window = k, window
        self.sizes = np.array([len(w) for w in docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        n = int(self.sizes.sum())
        h = np.fromiter((xxhash.xxh64_intdigest(x) for w in docs for x in w), np.uint64, n)
        self.n, self.words, self.second = n, h, None
        self.first = self._sums(h, _BASE, _INVERSE)

    def _sums(self, h: np.ndarray, base: np.uint64, inverse: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the word hashes times powers of base, and the powers of its inverse."""
        with np.errstate(over="ignore"):
            power = np.full(self.n, base, np.uint64)
            back = np.full(self.n + 1, inverse, np.uint64)
            power[:1] = back[0] = 1
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(h * np.multiply.accumulate(power), out=sums[1:])
            return sums, np.multiply.accumulate(back)

    @staticmethod
    def _span(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((sums[b] - sums[a]) * back[a])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._span(*self.first, a, b)

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A second hash of the same spans, over other word hashes and another base: 32 bits."""
        if self.second is None:
            with np.errstate(over="ignore"):
                self.second = self._sums(_mixed(self.words + _CHECK_BASE), _CHECK_BASE, _CHECK_INVERSE)
        return (self._span(*self.second, a, b) >> np.uint64(32)).astype(np.uint32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows, and the start of each one's node."""
        if self.n < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width, parts = self.window - self.k + 1, []
        # positions take the low 24 bits beside the hash: counted from the start of stretches of half as many words
        for lo in range(0, self.n - self.window + 1, 1 << 23):
            at = np.arange(lo, min(self.n - self.k + 1, lo + (1 << 23) + width - 1))
            key, have = (self.hash(at, at + self.k) & ~np.uint64(0xFFFFFF)) | (at - lo).astype(np.uint64), 1
            while 2 * have <= width:
                key = np.minimum(key[:-have], key[have:])
                have *= 2
            if have < width:
                key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
            parts.append((key & np.uint64(0xFFFFFF)).astype(np.int64) + lo)
        node = np.concatenate(parts)
        room = np.zeros(self.n + 1, np.int64)
        fits = self.sizes >= self.window
        np.add.at(room, self.starts[fits], 1)
        np.add.at(room, self.ends[fits] - self.window + 1, -1)
        ok = np.flatnonzero(np.cumsum(room)[: len(node)] > 0)
        return ok, node[ok]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _nodes(of: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Distinct nodes in order; of: each window's node, doc: each window's document."""
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
    return of[new]


def chunks(rows: list, size) -> Iterator[list]:
    held, words = [], 0
    for r in rows:
        held.append(r)
        words += size(r)
        if words >= _CHUNK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("th"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in carry or [id_col])).alias("carry"))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Every node occurrence: hash h, key (k, th), word position pos, edge hashes came and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            rows = [(i, split_words(t)) for i, t in enumerate(texts)]
            for part in chunks([r for r in rows if len(r[1]) >= window], lambda r: len(r[1])):
                s = Spans([w for _, w in part], window, k)
                win, of = s.windows()
                a = _nodes(of, s.document(win))
                d = s.document(a)
                came = np.full(len(a), START, np.uint64)
                went = np.full(len(a), END, np.uint64)
                on = np.flatnonzero(d[1:] == d[:-1])
                went[on] = came[on + 1] = s.hash(a[on], a[on + 1] + k)
                row = pa.array(np.array([i for i, _ in part])[d])
                arrays = [pa.array(s.hash(a, a + k).view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array((a - s.starts[d]).astype(np.int32)), pa.array(came.view(np.int64)), pa.array(went.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "k", "th", "pos", "came", "went"])

    return _keyed(docs, id_col, text_col).select("k", "th", "text").mapInArrow(run, "h long, k long, th long, pos int, came long, went long")


def hot_keys(counts: DataFrame) -> DataFrame:
    """counts, rows of distinct keys and their count n, with hot: whether a key holds more than 1 in HOT of all that is counted."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.withColumn("hot", F.col("n") > total // HOT)


def graph(docs: DataFrame, **kw) -> DataFrame:
    """Per row key, its repeated nodes: at, their positions, and plain, whether each is on a nonbranching path."""
    every = stored(nodes(docs, **kw), "nodes")
    twice = hot_keys(stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts"))
    marked = every.join(F.broadcast(twice.where("hot").select("h", "hot")), "h", "left")
    rest = marked.where("hot IS NULL").drop("hot").join(twice.where("NOT hot").select("h", "hot"), "h")
    again = stored(marked.where("hot").unionByName(rest), "repeated")

    def placed(part: DataFrame, hint) -> DataFrame:
        degree = part.groupBy("h").agg((F.min("came") == F.max("came")).alias("one_in"), (F.min("went") == F.max("went")).alias("one_out"))
        return part.join(hint(degree), "h").select("k", "th", F.struct("pos", (F.col("one_in") & F.col("one_out")).alias("plain")).alias("x"))

    both = placed(again.where("hot"), F.broadcast).unionByName(placed(again.where("NOT hot"), lambda x: x))
    lists = both.groupBy("k", "th").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return lists.select("k", "th", F.col("x.pos").alias("at"), F.col("x.plain").alias("plain"))


def recurring(windows: DataFrame, accepted: DataFrame) -> DataFrame:
    """(k, th, hit): per row key the places of its windows (k, th, wpos, whash, wcheck) whose both hashes come again, among the accepted (whash, wcheck), too."""
    name = ["whash", "wcheck"]
    counted = windows.select(*name, F.lit(True).alias("asked")).unionByName(accepted.select(*name, F.lit(False).alias("asked")))
    twice = hot_keys(stored(counted.groupBy(*name).agg(F.count("*").alias("n"), F.max("asked").alias("asked")).where("n > 1 AND asked").select(*name, "n"), "windows"))
    marked = windows.join(F.broadcast(twice.where("hot").select(*name, "hot")), name, "left")
    rest = marked.where("hot IS NULL").drop("hot").join(twice.where("NOT hot").select(*name), name)
    hits = marked.where("hot").drop("hot").unionByName(rest)
    return hits.groupBy("k", "th").agg(F.collect_set("wpos").alias("hit"))


def _paths(anchors: np.ndarray, plain: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Repeated spans [a, b): each run of consecutive nonbranching nodes, with the nodes beside it."""
    out, i, n = [], 0, len(anchors)
    while i < n:
        if not plain[i]:
            i += 1
            continue
        j = i
        while j + 1 < n and plain[j + 1]:
            j += 1
        out.append((int(anchors[max(i - 1, 0)]), int(anchors[min(j + 1, n - 1)]) + k))
        i = j + 1
    return out


def removed_mask(n: int, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in windows that start at the given places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:n]) > 0


def _finish(w: list[bytes], at: np.ndarray, window: int, digest: bool) -> tuple[int, str]:
    gone = removed_mask(len(w), at, window)
    kept = b" ".join(x for x, g in zip(w, gone.tolist()) if not g)
    return int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass")


DONE = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, digest: bool = False, untouched: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, carry) of every row.

    Removes each word covered by a window of `window` words whose sequence also starts anywhere
    else in the input. kept: the words left, joined by one space, or with digest its SHA-256 in
    hex; with untouched, the text as it is where no word is removed. carry: a struct of the row's
    columns named in `carry`, passed through. Null text counts as empty; texts shorter than a window and tables without
    repeats are kept whole; repeated rows count as copies of each other; an empty table gives
    no rows; further columns are ignored unless carried.
    """
    out = "doc_id long, k long, th long, n_words long, n_removed long, kept string, text string, sure array<int>, wpos array<int>, whash array<long>, wcheck array<int>, also array<long>, alsocheck array<int>"
    carried = _keyed(docs, id_col, text_col, carry).schema["carry"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split()[0] for f in out.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *(pa.list_(t()) for t in (pa.int32, pa.int32, pa.int64, pa.int32, pa.int64, pa.int32))]
        for b in batches:
            ids, ks, ths, texts = (b.column(i).to_pylist() for i in range(4))
            at, plain = b.column(4), b.column(5)
            rows = [(i, split_words(t)) for i, t in enumerate(texts)]
            done = 0
            for part in chunks(rows, lambda r: len(r[1]) + 20):
                found = []
                open_ = [r for r in part if at[r[0]].is_valid]
                pending = {}
                if open_:
                    s = Spans([w for _, w in open_], window, k)
                    win, of = s.windows()
                    d = s.document(win)
                    for j, (i, w) in enumerate(open_):
                        lo, hi = np.searchsorted(d, [j, j + 1])
                        p, o = win[lo:hi] - s.starts[j], of[lo:hi] - s.starts[j]
                        rep, flat = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, bool)
                        places = at[i].values.to_numpy()
                        rep[places] = True
                        flat[places] = plain[i].values.to_numpy(zero_copy_only=False)
                        nodes_ = _nodes(o, np.zeros(len(o), np.int64))
                        sure = np.zeros(len(p), bool)
                        for a, e in _paths(nodes_, flat[nodes_], k):
                            x, y = np.searchsorted(p, [a, e - window + 1])
                            sure[x:y] = True
                        ask = rep[o] & ~sure
                        q = p[ask] + s.starts[j]
                        e = p[sure & rep[o] & ~flat[o]] + s.starts[j]
                        pending[i] = (p[sure], p[ask], *(f(x, x + window).view(t) for x in (q, e) for f, t in ((s.hash, np.int64), (s.check, np.int32))))
                for i, w in part:
                    sure, ask, hashes, checks, also, also_checks = pending.get(i, (np.zeros(0, np.int64),) * 6)
                    if len(ask):
                        found.append((ids[i], ks[i], ths[i], len(w), None, None, texts[i], sure.astype(np.int32), ask.astype(np.int32), hashes, checks, also, also_checks))
                    else:
                        gone, kept = _finish(w, sure, window, digest)
                        if untouched and not gone:
                            kept = texts[i]
                        found.append((ids[i], ks[i], ths[i], len(w), gone, kept, None, None, None, None, None, *((also, also_checks) if len(also) else (None, None))))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*found), kinds)), b.column(6).slice(done, len(part))], [*names, "carry"])
                done += len(part)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = []
            for i, t in enumerate(texts):
                w = split_words(t)
                more = b.column(3)[i]
                at = np.concatenate([b.column(2)[i].values.to_numpy(), more.values.to_numpy() if more.is_valid else np.zeros(0, np.int32)]).astype(np.int64)
                gone, kept = _finish(w, at, window, digest)
                rows.append((ids[i], len(w), gone, t if untouched and not gone else kept))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), b.column(4)], ["doc_id", "n_words", "n_removed", "kept", "carry"])

    lists = graph(docs, id_col=id_col, text_col=text_col, window=window, k=k)
    with_nodes = _keyed(docs, id_col, text_col, carry).join(lists, ["k", "th"], "left").select("doc_id", "k", "th", "text", "at", "plain", "carry")
    judged = stored(with_nodes.mapInArrow(judge, StructType([*StructType.fromDDL(out), carried])), "judged")
    asked = judged.where("kept IS NULL")
    windows = asked.select("k", "th", F.explode(F.arrays_zip("wpos", "whash", "wcheck")).alias("w")).select("k", "th", "w.*")
    accepted = judged.select(F.explode(F.arrays_zip(F.col("also").alias("whash"), F.col("alsocheck").alias("wcheck"))).alias("w")).select("w.*")
    hits = recurring(windows, accepted)
    settled = asked.join(hits, ["k", "th"], "left").select("doc_id", "text", "sure", "hit", "carry").mapInArrow(settle, StructType([*StructType.fromDDL(DONE), carried]))
    return judged.where("kept IS NOT NULL").select("doc_id", "n_words", "n_removed", "kept", "carry").unionByName(settled)
