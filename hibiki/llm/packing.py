"""Variable-capacity best-fit packing.

Documents become pieces no longer than the largest capacity. Pieces are dealt in blocks of
bounded size, whatever their ids, and each block is packed on its own. The permitted capacities
are chosen jointly: for every set of them that holds the longest piece the block is packed, and
the plan of least total cost stays. Within a plan pieces in falling length go to the fullest
open bin that holds them; where none does, the set's capacity with the least cost per token
that can still be placed is opened; at the end each bin shrinks to the smallest permitted
capacity that holds its contents. A bin costs its tokens, a share of their square for
attention, and a fixed part, so that neither many short nor few long bins are always best.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stored, words

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin in tokens: its capacity, the capacity squared over ATTENTION, and BIN_COST.
BIN_COST, ATTENTION = 32, 32_768
#: Pieces that one task packs together.
BLOCK_PIECES = 20_000

OUT = "doc_id long, piece int, start long, length int, bin_id long, bin_offset int, capacity int"


def bin_price(capacity: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    return bin_cost + capacity + capacity * capacity / attention


def _plan(lengths: list[int], order: list[int], caps: list[int], price: dict[int, float], permitted: list[int]) -> tuple[float, list[int], list[int], list[int]]:
    """Cost, bins, offsets and final capacities by bin, of best-fit with bins opened in caps and shrunk to permitted ones."""
    open_bins: dict[int, list[int]] = defaultdict(list)  # free space to bins
    spaces = 0  # bit s is set while a bin has s free
    used, where, at = [], [0] * len(lengths), [0] * len(lengths)
    rest = int(sum(lengths))
    for i in order:
        n = lengths[i]
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = open_bins[space].pop()
            if not open_bins[space]:
                spaces &= ~(1 << space)
        else:
            space = min((c for c in caps if c >= n), key=lambda c: (price[c] / max(1, min(c, rest)), c))
            b = len(used)
            used.append(0)
        where[i], at[i] = b, used[b]
        used[b] += n
        open_bins[space - n].append(b)
        spaces |= 1 << space - n
        rest -= n
    final = [permitted[bisect_left(permitted, u)] for u in used]
    return sum(map(price.__getitem__, final)), where, at, final


def pack_lengths(lengths, capacities=CAPACITIES, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset in the bin, and final capacity of each piece; lengths over the largest capacity are an error."""
    permitted, lengths = sorted(capacities), list(map(int, lengths))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]] if order else 0
    if longest > permitted[-1]:
        raise ValueError("a piece is longer than the largest capacity")
    price = {c: bin_price(c, bin_cost, attention) for c in permitted}
    sets = (list(x) for k in range(1, len(permitted) + 1) for x in combinations(permitted, k) if x[-1] >= longest)
    _, where, at, final = min((_plan(lengths, order, x, price, permitted) for x in sets), key=lambda plan: plan[0])
    return where, at, [final[b] for b in where]


def pack(docs: DataFrame, capacities=CAPACITIES, length_col: str | None = None, text_col: str = "text", bin_cost: float = BIN_COST, block_pieces: int = BLOCK_PIECES, tokenizer: str | None = None, attention: float = ATTENTION) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_offset, capacity.

    A document's length is length_col, or its number of ids by the tokenizer file, end id
    included, or without either its number of words plus one. Null
    text counts as empty (length 1), a null or negative length as 0, which still gets one piece
    and a place. Longer documents are cut into pieces of the largest capacity and a remainder.
    Repeated ids are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    caps = sorted(int(c) for c in capacities)
    top = caps[-1]
    length = F.col(length_col) if length_col else F.size(words(F.col(text_col))) + 1
    if tokenizer and not length_col:
        docs, length = tokens.counted(docs, tokenizer, ["doc_id"], text_col), F.col("n_tokens")
    sized = stored(docs.select("doc_id", F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n")), "lengths")
    pieces = sized.select("doc_id", "n", F.explode(F.expr(f"sequence(0, int((greatest(n, 1) - 1) div {top}))")).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int").alias("length")
    )
    count = sized.agg(F.expr(f"sum((greatest(n, 1) - 1) div {top} + 1)")).first()[0] or 0
    blocks = max(1, -(-int(count) // block_pieces))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        where, at, final = pack_lengths(pdf["length"].tolist(), caps, bin_cost, attention)
        out = pdf[["doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = (np.int64(block) << 32) + np.asarray(where, dtype="int64")
        out["bin_offset"], out["capacity"] = np.asarray(at, dtype="int32"), np.asarray(final, dtype="int32")
        return out

    dealt = pieces.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(one, OUT)
