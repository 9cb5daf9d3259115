"""Token ids as raw binary shards, with a minimal perfect hash index from document key to offset.

Shard file: header (magic, id width in bytes, shard, part, documents, ids), the documents' keys
(int64) and id counts (uint32), then the raw little-endian ids of all documents, then one byte
that ends the record. Key files hold the header, keys and counts alone. Index file: one minimal
perfect hash for each hash class of keys, and in slot order a 32-bit fingerprint, shard, part,
offset in ids and count. A lookup hashes the key to its slot and compares the fingerprint, in
constant time whatever the number of documents.

All files go through Spark's committed writers, so any file system that Spark reaches will do,
and lost or repeated tasks leave no partial file.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

END_ID = 1
MAGIC = b"HBT1"
HEADER = struct.Struct("<4sIIIQQ")
#: Text bytes for each shard until there are MOST_SHARDS, which then grow; and bytes of ids after which a shard starts a further part.
SHARD_BYTES, MOST_SHARDS, PART_BYTES = 16 << 20, 100_000, 32 << 20
#: Keys of one hash class.
CLASS_KEYS = 200_000
#: Pieces whose ids a worker remembers, in each of two halves.
CACHE_WORDS = 350_000
NO_KEY = -(1 << 63)


def pack_header(*fields: int) -> bytes:
    return HEADER.pack(MAGIC, *fields)


#: A word of Latin letters, which the tokenizer's normaliser only lower-cases, and signs after it, which are a piece of their own.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


_ID = attrgetter("id")


def split_pieces(text: str | None) -> list[bytes]:
    """A text's pieces. ASCII is lower-cased, as the tokenizer does it, unless the text may hold a special token."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw if b"<|" in raw else raw.lower()).split()  # bytes split only at the six ASCII blanks


class Pieces(dict):
    """From a piece of text to its ids as bytes. What is not there comes from the older half of the memory, or from the encoder."""

    def __init__(self, make, older: dict):
        super().__init__()
        self.make, self.older = make, older

    def __missing__(self, piece: bytes) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            raw = self.make(piece)
        self[piece] = raw
        return raw


class WordEncoder:
    """A text's ids from a tokenizer that drops case and white space, so that texts encode piece by piece.

    Ids of pieces are remembered. A new piece that is a Latin word, with or without signs after
    it, goes to the tokenizer's model at once, word and signs apart, since its normaliser and
    pre-tokenizer would only lower and cut it so; other pieces go through the whole tokenizer.
    Ids are those of encoding each whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.split_word = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known = Pieces(self._make, {})
        self.end = np.array([END_ID], self.dtype).tobytes()
        bytes_as = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = "".join(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]))
        #: How the model sees each character.
        self.seen_as = str.maketrans({c: bytes_as.pre_tokenize_str(c)[0][0] for c in latin})
        self.plain = True
        self.plain = self._agrees()

    def _agrees(self) -> bool:
        """Whether the short way gives the tokenizer's ids, on every letter and sign; another kind of tokenizer takes the long way for all."""
        tries = ["thereonß", "Éàçø", "don.", "x***", "ab,.;", "a_b", "_"] + [chr(c) + "q" for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)] + [f"o{chr(c)}" for c in range(0x21, 0x7F)]
        return all(self._make(t.encode()) == self._long(t) for t in tries)

    def _bytes(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _long(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _make(self, raw: bytes) -> bytes:
        piece = raw.decode("utf-8", "surrogatepass")
        m = _WORD.fullmatch(piece) if self.plain else None
        if m is None:
            return self._long(piece)
        if m[2]:
            return self.known[m[1].encode()] + self.known[m[2].encode()]
        if not piece.isascii():
            piece = piece.lower().translate(self.seen_as)
        elif not piece.islower():
            piece = piece.lower()
        return self._bytes(map(_ID, self.split_word(piece)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as bytes, the end id appended. Of a full memory the older half goes."""
        if len(self.known) > CACHE_WORDS:
            self.known.older = {}
            self.known = Pieces(self._make, self.known)
        get = self.known.__getitem__
        return [b"".join(map(get, split_pieces(t))) + self.end for t in texts]

    def count(self, texts: list[str | None]) -> list[int]:
        """Each text's number of ids, with the end id."""
        return [len(x) // self.dtype.itemsize for x in self.encode(texts)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_binary(df: DataFrame, path: str) -> None:
    """Writes rows (kind, sub, blob): each blob as it is, and one closing byte, into a file under path/kind=."""
    df.select("kind", "sub", F.col("blob").cast("string").alias("value")).write.partitionBy("kind", "sub").text(path)


def read_binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind={kind}").select("content")


def write_shards(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every text and writes shards and key files under path, keys in ascending order over the shards.

    Null text counts as empty and gives the end id alone. A null key comes first and is stored
    as the smallest long. Equal keys are ordered by the hash of their text, and may go on in the
    next shard, so that no key makes a shard too large. An empty table writes no file.
    """
    if not shards:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size > 1 << 50:  # Spark does not know
            size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        shards = max(1, min(-(-size // SHARD_BYTES), MOST_SHARDS))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seal = F.xxhash64("text")
    rows = rows.repartitionByRange(shards, "key", seal).sortWithinPartitions("key", seal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, sub = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list[int] = []
        blobs: list[bytes] = []
        size = 0

        def part() -> pa.RecordBatch:
            counts = np.array([len(b) // enc.dtype.itemsize for b in blobs], "<u4")
            head = pack_header(enc.dtype.itemsize, shard, sub, len(keys), int(counts.sum(dtype=np.int64))) + np.array(keys, "<i8").tobytes() + counts.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(["ids", "keys"]), pa.array([sub, sub], pa.int32()), pa.array([b"".join([head, *blobs]), head], pa.binary())], ["kind", "sub", "blob"])

        for batch in batches:
            for c in range(0, batch.num_rows, 500):
                some = batch.slice(c, 500)
                keys += some.column(0).to_pylist()
                new = enc.encode(some.column(1).to_pylist())
                blobs += new
                size += sum(map(len, new))
                if size > PART_BYTES:
                    yield part()
                    keys, blobs, size, sub = [], [], 0, sub + 1
        if keys:
            yield part()

    write_binary(rows.mapInArrow(run, "kind string, sub int, blob binary"), path)


def _parse(blob: bytes) -> tuple[np.dtype, int, int, np.ndarray, np.ndarray, int]:
    """Id type, shard, part, keys, counts, and where the ids start."""
    magic, wide, shard, sub, n, _ = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a shard")
    at = HEADER.size
    keys = np.frombuffer(blob, "<i8", n, at)
    counts = np.frombuffer(blob, "<u4", n, at + 8 * n)
    return np.dtype(f"<u{wide}"), shard, sub, keys, counts, at + 12 * n


def _places(batches: Iterator[pa.RecordBatch], crc: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in b.column(0):
            blob = blob.as_buffer()
            kind, shard, sub, keys, counts, at = _parse(blob)
            ends = np.cumsum(counts.astype(np.int64))
            arrays = [pa.array(keys), pa.array(np.full(len(keys), shard, np.int32)), pa.array(np.full(len(keys), sub, np.int32)), pa.array(ends - counts), pa.array(counts.astype(np.int64))]
            names = ["key", "shard", "sub", "at", "n_tokens"]
            if crc:
                ids = np.frombuffer(blob, kind, int(ends[-1]), at)
                sums = [zlib.crc32(ids[e - c : e].astype("<u4")) for e, c in zip(ends.tolist(), counts.tolist())]
                arrays.append(pa.array(sums, pa.int64()))
                names.append("crc")
            yield pa.RecordBatch.from_arrays(arrays, names)


PLACE = "key long, shard int, sub int, at long, n_tokens long"


def _blobs(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return read_binary(spark, path, kind) if there else None


def places(spark: SparkSession, path: str) -> DataFrame:
    """Every record's key, shard, part, offset and count, from the key files."""
    blobs = _blobs(spark, path, "keys")
    return spark.createDataFrame([], PLACE) if blobs is None else blobs.mapInArrow(lambda it: _places(it, False), PLACE)


def records(spark: SparkSession, path: str) -> DataFrame:
    """places and the crc32 of the ids as unsigned 32-bit integers, from the shards themselves."""
    blobs = _blobs(spark, path, "ids")
    return spark.createDataFrame([], PLACE + ", crc long") if blobs is None else blobs.mapInArrow(lambda it: _places(it, True), PLACE + ", crc long")


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys: keys that meet at one level go on to the next."""

    LOAD = 1.5

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.size = int(sum(int(x.sum()) for x in levels))
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            m = max(1, int(cls.LOAD * len(keys))) | 1
            h = (_hash(keys, len(levels) + 1) % np.uint64(m)).astype(np.int64)
            count = np.bincount(h, minlength=m)
            levels.append(count == 1)
            keys = keys[count[h] > 1]
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; of a key that was never put in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            h = (_hash(keys[left], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[h]
            out[left[hit]] = self.base[i] + self.rank[i][h[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack(f"<I{len(self.levels)}I", len(self.levels), *map(len, self.levels)) + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes, at: int = 0) -> tuple[PerfectHash, int]:
        (n,) = struct.unpack_from("<I", raw, at)
        sizes = struct.unpack_from(f"<{n}I", raw, at + 4)
        at, levels = at + 4 + 4 * n, []
        for m in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), at), count=m).astype(bool))
            at += -(-m // 8)
        return cls(levels), at


#: What the index stores of a slot.
SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("sub", "<i4"), ("at", "<i8"), ("n", "<u4")])


def build_class(keys: np.ndarray, shard, sub, at, n) -> bytes:
    mph = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    where = mph.slot(keys)
    for name, value in (("print", _hash(keys, 0) >> np.uint64(32)), ("shard", shard), ("sub", sub), ("at", at), ("n", n)):
        slots[name][where] = value
    return mph.dump() + slots.tobytes()


def find_in_class(raw: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and their slots' records."""
    mph, at = PerfectHash.load(raw)
    slots = np.frombuffer(raw, SLOT, mph.size, at)
    where = mph.slot(keys)
    rec = slots[np.maximum(where, 0)] if mph.size else np.zeros(len(keys), SLOT)
    return (where >= 0) & (rec["print"] == (_hash(keys, 0) >> np.uint64(32))), rec


def write_index(spark: SparkSession, path: str) -> int:
    """Builds the index of the shards under path; returns the number of hash classes. A key's first record is indexed; null keys are not."""
    first = places(spark, path).where(F.col("key") != NO_KEY).groupBy("key").agg(F.min(F.struct("shard", "sub", "at", "n_tokens")).alias("x")).select("key", "x.*")
    classes = max(1, -(-places(spark, path).count() // CLASS_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = build_class(pdf["key"].to_numpy(), pdf["shard"], pdf["sub"], pdf["at"], pdf["n_tokens"])
        c = int(pdf["class"].iloc[0])
        return pd.DataFrame({"kind": ["index"], "sub": [0], "blob": [struct.pack("<I", c) + blob]})

    dealt = first.withColumn("class", F.pmod(F.xxhash64("key"), F.lit(classes)).cast("int"))
    one_each = dealt.groupBy("class").applyInPandas(build, "kind string, sub int, blob binary")
    # a file may hold one record only: each class is written by a task of its own
    write_binary(one_each.select("kind", F.conv(F.hex(F.reverse(F.substring("blob", 1, 4))), 16, 10).cast("int").alias("sub"), "blob"), f"{path}/index")
    return classes


def lookup(keys: DataFrame, path: str, classes: int, whole: bool = False) -> DataFrame:
    """(key, shard, sub, at, n_tokens) of those of keys(key) that the index has. whole: a key that it has not is an error."""
    spark = keys.sparkSession
    blobs = _blobs(spark, f"{path}/index", "index")
    if blobs is None:
        return spark.createDataFrame([], PLACE)
    index = blobs.select(F.conv(F.hex(F.reverse(F.substring("content", 1, 4))), 16, 10).cast("int").alias("class"), "content")
    asked = keys.select("key").distinct().withColumn("class", F.pmod(F.xxhash64("key"), F.lit(classes)).cast("int"))

    def find(k: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(k):
            return pd.DataFrame({"key": [], "shard": [], "sub": [], "at": [], "n_tokens": []})
        keys_ = k["key"].to_numpy()
        there, rec = find_in_class(bytes(i["content"].iloc[0])[4:], keys_) if len(i) else (np.zeros(len(keys_), bool), np.zeros(0, SLOT))
        if whole and not there.all():
            raise ValueError(f"the index has no record of {int((~there).sum())} keys, of {keys_[~there][0]} for one")
        rec = rec[there] if len(rec) else rec
        return pd.DataFrame({"key": keys_[there], "shard": rec["shard"], "sub": rec["sub"], "at": rec["at"], "n_tokens": rec["n"].astype("int64")})

    return asked.groupBy("class").cogroup(index.groupBy("class")).applyInPandas(find, PLACE)


#: Parts up to which a fetch opens only those that it needs, by name; beyond, it reads them all.
NAMED_PARTS = 10_000


def _part_files(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> list[str]:
    """The id files of the given (shard, part): a task writes its shard's parts, and Spark names a file by its task."""
    jvm, out = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for shard, sub in parts:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/kind=ids/sub={sub}/part-{shard:05d}-*")
        found = p.getFileSystem(conf).globStatus(p)
        if not found:
            raise ValueError(f"the index names part {sub} of shard {shard}, which is not there")
        out += [f.getPath().toString() for f in found]
    return out


def fetch(keys: DataFrame, path: str, classes: int) -> DataFrame:
    """(key, ids array<int>) of those of keys(key) that the index has, read from the payloads where the index says.

    One lookup in the hash gives a key's part and offset; only parts that hold an asked key are
    opened, and only the asked ids are taken from them. Null keys and keys that were never put in
    give no row; of a repeated key the first record counts, the end id included.
    """
    spark = keys.sparkSession
    places_ = lookup(keys.where("key IS NOT NULL"), path, classes)
    asked = places_.groupBy("shard", "sub").agg(F.collect_list(F.struct("key", "at", "n_tokens")).alias("asked"))
    from .common import stored

    asked = stored(asked, "asked")
    some = [(r.shard, r["sub"]) for r in asked.select("shard", "sub").limit(NAMED_PARTS + 1).collect()]
    if not some:
        return spark.createDataFrame([], "key long, ids array<int>")
    files = [f"{path}/kind=ids"] if len(some) > NAMED_PARTS else _part_files(spark, path, some)
    number = lambda at: F.conv(F.hex(F.reverse(F.substring("content", at, 4))), 16, 10).cast("int")
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select(number(9).alias("shard"), number(13).alias("sub"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                blob = b.column(0)[i].as_buffer()
                kind, _, _, own, counts, at = _parse(blob)
                ids = np.frombuffer(blob, kind, int(counts.sum(dtype=np.int64)), at)
                first = np.cumsum(counts.astype(np.int64)) - counts
                found = b.column(1)[i].as_py()
                for x in found:
                    k = int(np.searchsorted(first, x["at"]))
                    if k >= len(own) or first[k] != x["at"] or own[k] != x["key"] or counts[k] != x["n_tokens"]:
                        raise ValueError(f"the index leads to a wrong record for key {x['key']}")
                taken = [ids[x["at"] : x["at"] + x["n_tokens"]].astype(np.int32) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in found], pa.int64()), pa.array(taken, pa.list_(pa.int32()))], ["key", "ids"])

    # asked places are few beside the payloads: the payloads go to them only where both are large
    return blobs.join(asked, ["shard", "sub"]).select("content", "asked").mapInArrow(run, "key long, ids array<int>")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, sub, base): ids of all documents in earlier parts. One row a part goes through the running sum."""
    from pyspark.sql import Window

    sums = places(spark, path).groupBy("shard", "sub").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", "sub", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))


def read_back(keys: DataFrame, path: str, classes: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record under path, keys(key) being all keys put in.

    The index says where a key's first record lies, and so which payload, of how many ids, at
    which start, is that key's. Records that it need not know, of repeated and null keys, are
    named by the shard's directory. A place that holds no record, or one of another key or
    length, is an error, and so is a key that the index does not know.
    """
    spark = keys.sparkSession
    found = lookup(keys.where("key IS NOT NULL"), path, classes, whole=True)
    found = found.select("shard", "sub", "at", F.col("key").alias("named"), F.col("n_tokens").alias("long"))
    rec = records(spark, path).withColumnRenamed("key", "own")
    both = rec.join(found, ["shard", "sub", "at"], "full")
    wrong = F.col("named").isNotNull() & (F.col("own").isNull() | (F.col("own") != F.col("named")) | (F.col("n_tokens") != F.col("long")))
    key = F.when(wrong, F.raise_error(F.concat(F.lit("the index leads to a wrong record for key "), F.col("named").cast("string"))).cast("long")).otherwise(F.coalesce("named", F.nullif("own", F.lit(NO_KEY))))
    return both.join(starts(spark, path), ["shard", "sub"], "left").select(key.alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), F.coalesce("long", "n_tokens").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards and index to the shared folder, reads them back: (doc_id, start, n_tokens, ids_crc32) of every row."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_shards(docs, tokenizer, path, id_col, text_col)
    classes = write_index(spark, path)
    return read_back(docs.select(F.col(id_col).cast("long").alias("key")), path, classes)


def counted(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and n_tokens long, the number of ids of each row's text with the end id; null text counts as empty."""
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*docs.select(*keep).schema, *StructType().add("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = [x for c in range(0, len(texts), 500) for x in enc.count(texts[c : c + 500])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("_text_to_count")).mapInArrow(run, schema)
