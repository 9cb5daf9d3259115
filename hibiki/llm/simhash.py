"""SimHash near-duplicate groups through deletion-variant signatures.

A 64-bit fingerprint is cut into MAX_BITS // 2 + 1 segments. Two fingerprints that differ in at
most MAX_BITS bits then have a segment in which they differ in at most one bit, and so share
one of that segment's one-wildcard variants (the segment with one bit masked). Equality on
(masked position, masked segment) brings them together; the full distance is verified there.

Rows are reduced to distinct fingerprints before anything is joined, and a bucket never emits
all pairs: it returns links that connect what is near. `representatives`, for the pipeline,
verifies its links by the similarity of the texts' shingles as well. Buckets with more than BLOCK
fingerprints are cut into blocks, and pairs of blocks go to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, salted, stored

SEED = 42
MAX_BITS = 4
#: Fingerprints of a bucket that are compared in one place.
BLOCK = 2_000
#: Hot buckets up to this many are broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = 4) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 for null or a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and just the six ASCII blanks
    if not w:
        return 0
    joined = b" ".join(w)
    n = max(1, len(w) - size + 1)
    lengths = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    first, last = starts[:n].tolist(), (ends[size - 1 :] - 1).tolist() if len(w) >= size else [len(joined)]
    ones = np.zeros(64, np.int64)
    for c in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[c : c + _CHUNK], last[c : c + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Segments [lo, hi) so many that one of them differs by one bit at most."""
    m = max_bits // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return list(zip(cuts, cuts[1:]))


def _fold(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the links a-b into the labels: afterwards a component's label is its smallest member."""
    while True:
        lo = np.minimum(lab[a], lab[b])
        if np.array_equal(lab[a], lab[b]):
            return
        for side in (lab[a], lab[b]):
            np.minimum.at(lab, side, lo)
        while not np.array_equal(lab, nxt := lab[lab]):
            lab[:] = nxt


def forest(run: np.ndarray, node: np.ndarray, bits: list[np.ndarray], max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal runs that connect whatever is within max_bits there; run is sorted. Every link is a pair within max_bits; pairs that are already connected give none."""
    again = np.zeros(len(run), bool)
    if len(run) > 1:
        same = run[1:] == run[:-1]
        again[1:] |= same
        again[:-1] |= same
    run, bits = run[again], [x[again].view(np.uint64) for x in bits]
    names, at = np.unique(node[again], return_inverse=True)
    lab = np.arange(len(names))
    out_a, out_b = [], []
    idx, d = np.arange(len(run)), 0
    while len(idx):
        d += 1
        idx = idx[idx + d < len(run)]
        idx = idx[run[idx] == run[idx + d]]
        far = sum(np.bitwise_count(x[idx] ^ x[idx + d]).astype(np.int16) for x in bits)
        near = idx[far <= max_bits]
        near = near[lab[at[near]] != lab[at[near + d]]]
        if len(near):
            a, b = at[near], at[near + d]
            out_a.append(names[a])
            out_b.append(names[b])
            _fold(lab, a, b)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def links(fps: DataFrame, max_bits: int = MAX_BITS, cols: tuple[str, ...] = ("fp",), node: str = "fp", segs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Links (a, b) between the nodes of fps that connect what max_bits or fewer bits connect.

    A fingerprint is the columns cols, 64 bits each, which all have the same segments segs. With
    the default segments of one column no link is lost; of others, those whose pair has a
    segment that differs by one bit at most are found.
    """
    segs = segments(max_bits) if segs is None else segs
    parts = [(c, lo, hi) for c in range(len(cols)) for lo, hi in segs]
    cut = lambda c, lo, hi: f"shiftrightunsigned({cols[c]}, {lo}) & {(1 << hi - lo) - 1}L"
    values = [f"named_struct('s', {k}, 'v', {cut(*part)})" for k, part in enumerate(parts)]
    hot = (
        fps.select(F.explode(F.expr(f"array({', '.join(values)})")).alias("x"))
        .groupBy("x.s", "x.v")
        .count()
        .where(F.col("count") > BLOCK // 2)
    )
    of_seg = F.expr("CASE s " + " ".join(f"WHEN {k} THEN array({', '.join(f'struct({64 * c + p} as p, v & {~(1 << p - lo)}L as v)' for p in range(lo, hi))})" for k, (c, lo, hi) in enumerate(parts)) + " END")
    hot = stored(
        hot.select(F.explode(of_seg).alias("x"), "count")
        .groupBy(F.col("x.p").alias("p"), F.col("x.v").alias("v"))
        .agg(F.ceil((F.sum("count") + BLOCK // 2) / BLOCK).cast("int").alias("blocks")),
        "hot",
    )
    each = [f"named_struct('p', {64 * c + p}, 'v', shiftrightunsigned({cols[c]}, {lo}) & {((1 << hi - lo) - 1) & ~(1 << p - lo)}L)" for c, lo, hi in parts for p in range(lo, hi)]
    own = list(dict.fromkeys([node, *cols]))
    spread = fps.repartition(salted(fps.sparkSession), node)  # each row becomes many: not from the few tasks of a small table
    rows = spread.select(*own, F.explode(F.expr(f"array({', '.join(each)})")).alias("x")).select(*own, "x.p", "x.v")
    found = hot.count()
    if found:
        rows = rows.join(F.broadcast(hot) if found <= BROADCAST_ROWS else hot, ["p", "v"], "left")
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.hash(node), "blocks"))
        rows = rows.select(*own, "p", "v", F.col("own"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        block = F.least("own", "other") * F.lit(1 << 16) + F.greatest("own", "other")
    else:
        block = F.lit(0)
    rows = rows.select(F.shiftleft(F.col("p").cast("long"), 40).bitwiseOR(F.col("v")).alias("key"), block.cast("int").alias("block"), *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows_held = 0

        def out(data: np.ndarray):
            change = np.ones(data.shape[1], bool)
            change[1:] = (data[0, 1:] != data[0, :-1]) | (data[1, 1:] != data[1, :-1])
            a, b = forest(np.cumsum(change), data[2].copy(), [data[2 + own.index(c)].copy() for c in cols], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            rows_held += batch.num_rows
            if rows_held >= 100_000:
                data = np.concatenate(held, axis=1)
                last = np.flatnonzero((data[0] != data[0, -1]) | (data[1] != data[1, -1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield out(data[:, :cut])
                held, rows_held = [data[:, cut:]], data.shape[1] - cut
        if rows_held:
            yield out(np.concatenate(held, axis=1))

    # by fingerprint within a bucket, so that neighbours are often near
    dealt = rows.repartition(salted(fps.sparkSession), "key", "block").sortWithinPartitions("key", "block", *cols)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, size: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest id reachable over links. Null and blank texts have fingerprint
    0 and link like any other; rows with a null id get their group's id, or null where no row of
    the group has one; repeated rows come out repeated; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, size, id_col, text_col), "prints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = components(stored(links(fps.select("fp"), max_bits), "links"))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Shingles and similarity at which the pipeline takes documents for near copies; bits of 128 up to which pairs are looked at, and the segments of each half.
STAGE_SIZE, STAGE_SIMILARITY, STAGE_BITS = 5, 0.8, 30
STAGE_SEGMENTS = [(0, 16), (16, 32), (32, 48), (48, 64)]
#: Nodes of a group that are compared in one place when a link of the group fails.
GROUP_BLOCK = 400


def shingles(text: str | None, size: int = STAGE_SIZE) -> np.ndarray:
    """128-bit hashes of a text's word shingles, as rows of two 64-bit numbers; a shorter text has one, a text without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros((0, 2), np.uint64)
    joined, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    n = max(1, len(w) - size + 1)
    first, last = [0, *ends[: n - 1].tolist()], (ends[size - 1 :] - 1).tolist() if len(w) >= size else [len(joined)]
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[a:b], SEED) for a, b in zip(first, last)), ">u8").astype(np.uint64).reshape(-1, 2)


def wide_print(text: str | None, size: int = STAGE_SIZE) -> tuple[int, int, int]:
    """The hash of a text's set of shingles, and its 128-bit SimHash as two signed numbers; all 0 without words."""
    h = shingles(text, size)
    if not len(h):
        return 0, 0, 0
    ones = np.zeros(128, np.int64)
    for c in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[c : c + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(h), bitorder="little").view("<i8").tolist()
    mark = xxhash.xxh64_intdigest(np.unique(h[:, 0]).tobytes(), SEED)
    return mark - (1 << 64) if mark >> 63 else mark, a, b


def shingle_set(text: str | None, size: int = STAGE_SIZE) -> np.ndarray:
    """A text's distinct shingles by 32 bits of their hash, in order."""
    return np.unique((shingles(text, size)[:, 1] >> np.uint64(32)).astype(np.uint32))


def similar_links(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs of the sets have a similarity of at least `least`."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    values, column = np.unique(np.concatenate([np.zeros(0, sets[0].dtype if n else np.int32), *sets]), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    both = np.zeros((n, n), np.float32)
    step = max(1, (2 << 20) // max(1, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, len(values), step):
        lo, hi = np.searchsorted(column, [c, c + step])
        m = np.zeros((n, min(step, len(values) - c)), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        both += m @ m.T
    whole = sizes[:, None] + sizes[None] - both
    a, b = np.nonzero(np.triu(both >= least * whole - 1e-6, 1))
    lab, keep = np.arange(n), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        u, v = x, y
        while lab[u] != u:
            lab[u] = lab[lab[u]]
            u = lab[u]
        while lab[v] != v:
            lab[v] = lab[lab[v]]
            v = lab[v]
        if u != v:
            lab[max(u, v)] = min(u, v)
            keep.append(i)
    return a[keep], b[keep]


def verified(found: DataFrame, sets: DataFrame, least: float = STAGE_SIMILARITY) -> DataFrame:
    """Links (a, b) that connect what is similar among candidate links found(a, b); sets(node, s): every linked node's shingles, an array<int> without repeats.

    A candidate link whose pair is similar enough stays. Where all links of a candidate group
    stay, the group is connected as it should be. The nodes of every other group are compared
    with each other, in blocks, so that no similar pair of the group is lost with a link that
    only stood for it.
    """
    both = found.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    # natively, a pair at a time: batches of pairs of sets would lie in memory twice, in the JVM's buffers and in Python
    common = F.size(F.array_intersect("x", "y"))
    judged = both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).alias("m"))
    judged = stored(judged.select("a", "b", (F.col("n") / F.greatest(F.lit(1), F.col("m") - F.col("n")) >= least - 1e-9).alias("ok")), "judged")
    good = judged.where("ok").select("a", "b")
    failed = judged.where("NOT ok")
    if not failed.limit(1).count():
        return good
    roots = stored(components(found, "candidates"), "roots")
    doubtful = failed.join(roots, failed.a == roots.node).select("root").distinct()
    members = roots.join(doubtful, "root")
    size = members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(GROUP_BLOCK)).cast("int").alias("blocks"))
    laid = members.join(size, "root").join(sets, "node").withColumn("own", F.pmod(F.hash("node"), "blocks"))
    laid = laid.select("root", "node", "s", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    laid = laid.select("root", "node", "s", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(group: pa.Table) -> pa.Table:
        nodes, lists = group["node"].to_numpy(), group["s"].combine_chunks()
        flat = pc.list_flatten(lists).to_numpy()
        a, b = similar_links(np.split(flat, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]), least)
        return pa.table({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b])})

    return good.unionByName(laid.select("root", "lo", "hi", "node", "s").groupBy("root", "lo", "hi").applyInArrow(compare, "a long, b long"))


def representatives(docs: DataFrame, size: int = STAGE_SIZE, least: float = STAGE_SIMILARITY, max_bits: int = STAGE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seal, again): of each group the row with the least id and text hash; again: whether several rows have both.

    Texts with equal sets of shingles are one node. Candidate links come from 128-bit SimHashes
    with a 16-bit segment that differs in one bit at most, and count only if the shingles'
    Jaccard similarity is at least `least`. Null and blank texts are one group.
    """
    seal = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), seal.alias("seal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [wide_print(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], ["doc_id", "seal", "mark", "fa", "fb"])

    prints = stored(rows.mapInArrow(run, "doc_id long, seal long, mark long, fa long, fb long"), "prints")
    nodes = prints.groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "seal")).alias("first"), F.min("fa").alias("fa"), F.min("fb").alias("fb"))
    nodes = stored(nodes, "nodes")
    found = stored(links(nodes.where("mark <> 0").select("mark", "fa", "fb"), max_bits, ("fa", "fb"), "mark", STAGE_SEGMENTS), "links")
    linked = found.select(F.col("a").alias("mark")).unionByName(found.select(F.col("b").alias("mark"))).distinct()
    chosen = nodes.join(linked, "mark").select(F.col("first.doc_id").alias("d"), F.col("first.seal").alias("s"), "mark")
    texts = rows.join(chosen, rows.doc_id.eqNullSafe(chosen.d) & (rows.seal == chosen.s)).select("mark", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, size).view(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["node", "s"])

    # rows with equal id and text give equal sets: one of them
    sets = stored(texts.mapInArrow(gather, "node long, s array<int>").groupBy("node").agg(F.first("s").alias("s")), "sets")
    roots = components(stored(verified(found, sets, least), "verified"))
    rooted = nodes.join(roots, nodes.mark == roots.node, "left").select("first", F.coalesce("root", "mark").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("x")).select("x.doc_id", "x.seal")
    times = prints.groupBy("doc_id", "seal").count().select(F.col("doc_id").alias("d"), F.col("seal").alias("s"), (F.col("count") > 1).alias("again"))
    return best.join(times, best.doc_id.eqNullSafe(times.d) & (best.seal == times.s)).select("doc_id", "seal", "again")
