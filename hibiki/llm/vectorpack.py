"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens.

Examples become token ids in the tasks that read them. A task gathers examples up to
BLOCK_TOKENS ids, packs them, writes their pieces and goes on: nothing is shuffled, and a task's
memory is bounded by a block and one example. Sequences are filled one after the other. Of the
examples that fit whole, the next one is that with the largest dot product of its demand and the
free space, each dimension measured in shares of its limit and weighted by the block's demand on
it. Where none fits whole, the longest is cut so that the sequence is filled. A sequence that
still ends short, at the end of a block or at its limit of segments or loss-bearing tokens, is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

END_ID = 2
#: Ids that one task packs together; a longer example is a block of its own.
BLOCK_TOKENS = 4_000_000
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    """Of one sequence: ids, segments (pieces of examples), and ids that bear loss."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    loss: int
    sequence: int
    offset: int


class Example:
    """n ids; where not all of them bear loss, how many of the first i do, for i from 0 to n."""

    def __init__(self, n: int, losses: np.ndarray | None = None):
        self.n, self.losses = n, losses

    def loss(self, start: int, end: int) -> int:
        return end - start if self.losses is None else int(self.losses[end] - self.losses[start])

    def reach(self, start: int, n: int, loss: int) -> int:
        """How many ids from start come before the n-th further one and before more than `loss` of them bear loss."""
        n = min(n, self.n - start)
        if self.losses is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.losses, self.losses[start] + loss, "right")) - 1 - start)


class Pool:
    """Rests of examples, those of equal demand (ids, loss-bearing ids) together."""

    def __init__(self, limits: Limits, demand: np.ndarray):
        self.limits = np.array(limits, float)
        self.weight = demand / self.limits
        self.at: dict[tuple[int, int], int] = {}
        self.rests: list[list[tuple[int, int]]] = []
        self.need = np.zeros((3, 1024))
        self.left = np.zeros(1024, np.int64)

    def put(self, key: tuple[int, int], rest: tuple[int, int]) -> None:
        k = self.at.get(key)
        if k is None:
            k = self.at[key] = len(self.rests)
            self.rests.append([])
            if k == len(self.left):
                self.need, self.left = np.hstack([self.need, np.zeros_like(self.need)]), np.r_[self.left, np.zeros_like(self.left)]
            self.need[:, k] = key[0], 1, key[1]
        self.rests[k].append(rest)
        self.left[k] += 1

    def take(self, k: int) -> tuple[int, int]:
        self.left[k] -= 1
        return self.rests[k].pop()

    def best(self, free: np.ndarray) -> int | None:
        """The demand of largest dot product with the free space among those that fit; of equals the one first put in."""
        m = len(self.rests)
        need = self.need[:, :m]
        fits = (self.left[:m] > 0) & (need[0] <= free[0]) & (need[1] <= free[1]) & (need[2] <= free[2])
        if not fits.any():
            return None
        return int(np.argmax(np.where(fits, (self.weight * free / self.limits**2) @ need, -1.0)))

    def to_cut(self) -> int | None:
        """The longest rest, of equals the one with the least loss."""
        m = len(self.rests)
        there = np.flatnonzero(self.left[:m] > 0)
        if not len(there):
            return None
        return int(there[np.lexsort((self.need[2, there], -self.need[0, there]))[0]])


def powers(n: int) -> list[int]:
    """The powers of two that make up n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def fill(examples: list[Example], limits: Limits = Limits(), downsize: bool = True) -> list[Piece]:
    """Pieces of all examples by the dot-product heuristic, each id in one; sequences number from 0.

    downsize: a sequence that is not full is cut into ones of power-of-two length. Limits below
    one id, one segment or, where ids bear loss, one such id are an error.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
        raise ValueError("a sequence must hold one id at least")
    total = [sum(e.n for e in examples), len(examples), sum(e.loss(0, e.n) for e in examples)]
    pool = Pool(limits, np.array(total, float))
    out: list[Piece] = []
    sequences = 0

    def close(held: list[tuple[int, int, int]], used: int) -> None:
        nonlocal sequences
        sizes = [used] if used == limits.tokens or not downsize else powers(used)
        ends = list(accumulate(sizes))
        s = at = 0
        for e, start, n in held:
            while n:
                k = min(n, ends[s] - at)
                out.append(Piece(e, start, k, examples[e].loss(start, start + k), sequences + s, at - (ends[s] - sizes[s])))
                start, n, at = start + k, n - k, at + k
                if at == ends[s] and s + 1 < len(ends):
                    s += 1
        sequences += len(sizes)

    def put(e: int, start: int) -> None:
        x = examples[e]
        while (n := x.reach(start, limits.tokens, limits.loss)) == limits.tokens and start + n < x.n:
            close([(e, start, n)], n)  # the middle of a long example fills sequences by itself
            start += n
        pool.put((x.n - start, x.loss(start, x.n)), (e, start))

    for e in range(len(examples)):
        if examples[e].n:
            put(e, 0)
    while pool.left.any():
        free = np.array(limits, float)
        held: list[tuple[int, int, int]] = []
        while free[0] > 0 and free[1] > 0:
            k = pool.best(free)
            if k is not None:
                e, start = pool.take(k)
                n = examples[e].n - start
            else:
                k = pool.to_cut()
                if k is None:
                    break
                e, start = pool.take(k)
                n = examples[e].reach(start, int(free[0]), int(free[2]))
                put(e, start + n)
                if not n:  # the sequence can bear no further loss
                    break
            held.append((e, start, n))
            free -= (n, 1, examples[e].loss(start, start + n))
        close(held, limits.tokens - int(free[0]))
    return out


def pack(examples: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END_ID, downsize: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset.

    examples(doc_id, text), every id bears loss; or examples(doc_id, parts
    array<struct<text string, loss boolean>>), such as the turns of a dialogue, where ids of parts
    with loss bear it and the end id does if the last part does. Null texts and parts are empty,
    a null mark is false; an example without words is its end id alone. Rows are packed one by
    one, also those of repeated or null ids; other columns are ignored; no rows give no pieces.
    Sequences are numbered by task and within it, offsets have no gaps.
    """
    by_parts = "parts" in examples.columns
    given = F.coalesce(F.col("parts").cast("array<struct<text:string,loss:boolean>>"), F.array()) if by_parts else F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), given.alias("given"))
    names = [f.split()[0] for f in OUT.split(", ")]

    def encoded(given: list) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        enc = tokens.encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        if not by_parts:
            return [np.concatenate([np.frombuffer(b, enc.dtype)[:-1], end]) for b in enc.encode(given)], [None] * len(given)
        ids, losses = [], []
        for parts in given:
            parts = [p for p in parts if p is not None]
            raw = [np.frombuffer(b, enc.dtype)[:-1] for b in enc.encode([p["text"] for p in parts])]
            bears = [np.full(len(x), bool(p["loss"])) for x, p in zip(raw, parts)]
            ids.append(np.concatenate([*raw, end]))
            losses.append(np.r_[0, np.cumsum(np.concatenate([*bears, [bool(parts and parts[-1]["loss"])]]))])
        return ids, losses

    def block(keys: list, ids: list[np.ndarray], losses: list, first: int) -> tuple[list[pa.RecordBatch], int]:
        pieces = fill([Example(len(x), y) for x, y in zip(ids, losses)], limits, downsize)
        wide = [x.astype("<u4") for x in ids]
        out = []
        for at in range(0, len(pieces), 20_000):
            e, start, length, loss, seq, offset = zip(*pieces[at : at + 20_000])
            crc = [zlib.crc32(wide[i][a : a + n]) for i, a, n in zip(e, start, length)]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([keys[i] for i in e], start, length, crc, [len(ids[i]) for i in e], loss, [first + s for s in seq], offset)], names))
        return out, first + 1 + max((p.sequence for p in pieces), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        losses: list = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 200):
                some = b.slice(at, 200)
                x, y = encoded(some.column(1).to_pylist())
                keys += some.column(0).to_pylist()
                ids += x
                losses += y
                size += sum(map(len, x))
                if size >= block_tokens:
                    done, first = block(keys, ids, losses, first)
                    yield from done
                    keys, ids, losses, size = [], [], [], 0
        if keys:
            yield from block(keys, ids, losses, first)[0]

    return rows.mapInArrow(run, OUT)
