"""Tidy word lists as a Spark data source: `spark.read.format("tidy_words").load(path)`.

The schema comes from the header, files are read in byte ranges that end at line ends, and the
row filter and the choice of columns work in the reader, before a row reaches Spark. Options:
where (the row filter language), columns (names, with commas between them; all by default) and
splitBytes. Files are found and opened by pyarrow's file systems, so paths may be URIs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.where import parse, references

SPLIT_BYTES = 32 << 20
#: Bytes that a reader takes at a time.
_STEP = 4 << 20
_BOM = b"\xef\xbb\xbf"


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=False))
    return system, sorted((x for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)


def names_of(header: str) -> list[str]:
    return [c.strip(" \t") if i else c for i, c in enumerate(header.removeprefix("﻿").split(","))]


def mask(query: str, columns: dict[str, pa.Array], n: int) -> pa.Array:
    """Which rows the filter keeps; as plans.where.compiled has it."""
    if not query.strip():
        return pa.array([True] * n)
    tree = parse(query)
    if tree is None or any(k not in columns for k in references(query)):
        return pa.array([False] * n)

    def read(x) -> pa.Array:
        if x[0] == "term":
            _, key, op, value = x
            cell = columns[key]
            if op in ("=", "!="):
                return pc.equal(cell, value) if op == "=" else pc.not_equal(cell, value)
            inside = pc.match_substring(pc.fill_null(cell, ""), value)
            return inside if op == "~=" else pc.invert(inside)
        return (pc.and_kleene if x[0] == "and" else pc.or_kleene)(read(x[1]), read(x[2]))

    return pc.fill_null(read(tree), False)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class TidyReader(DataSourceReader):
    def __init__(self, path: str, where: str, wanted: list[str], split_bytes: int):
        self.path, self.where, self.wanted, self.split_bytes = path, where, wanted, split_bytes

    def partitions(self) -> list[Range]:
        return [Range(x.path, a, min(a + self.split_bytes, x.size)) for x in _files(self.path)[1] for a in range(0, x.size, self.split_bytes)]

    def _lines(self, source, start: int, end: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Lines that begin in [start, end), and where."""
        at = start
        rest = b""
        if start:  # a line that begins before the range is the range before's
            source.seek(start - 1)
            skipped = True
            at = start - 1
        else:
            skipped = False
        while True:
            data = source.read(_STEP)
            block = rest + data
            if skipped:
                cut = block.find(b"\n")
                if cut < 0:
                    if not data:
                        return
                    at, rest = at + len(block), b""
                    continue
                at, block, skipped = at + cut + 1, block[cut + 1 :], False
            lines = block.split(b"\n")
            rest = lines.pop()
            places = []
            for x in lines:
                places.append(at)
                at += len(x) + 1
            if not data and rest:
                lines.append(rest)
                places.append(at)
            n = sum(p < end for p in places)
            if n:
                yield lines[:n], places[:n]
            if not data or n < len(places) or at >= end:
                return

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path) if "://" in self.path else (fs.LocalFileSystem(), None)
        with system.open_input_file(partition.path) as source:
            header = b""
            while b"\n" not in header and (more := source.read(65_536)):
                header += more
            names = names_of(header.split(b"\n")[0].decode().removesuffix("\r"))
            source.seek(0)
            for lines, places in self._lines(source, partition.start, partition.end):
                some = [(p, x.decode().removesuffix("\r")) for x, p in zip(lines, places) if p]  # the line at 0 is the header
                some = [(p, x) for p, x in some if x]
                if not some:
                    continue
                split = [[c.strip(" \t") if 0 < i < k - 1 else c.lstrip(" \t") if i and k > 1 else c.rstrip(" \t") if k > 1 else c for i, c in enumerate(row)] for row in (x.split(",") for _, x in some) for k in [len(row)]]
                columns = {n: pa.array([r[i] if i < len(r) else None for r in split], pa.string()) for i, n in enumerate(names)}
                keep = mask(self.where, columns, len(some))
                whole = {"file": pa.array([partition.path] * len(some)), "offset": pa.array([p for p, _ in some], pa.int64())} | columns
                empty = pa.nulls(len(some), pa.string())
                yield pa.RecordBatch.from_arrays([whole.get(c, empty) for c in self.wanted], self.wanted).filter(keep)


class TidyWords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidy_words"

    def _header(self) -> list[str]:
        system, files = _files(self.options["path"])
        for x in files:
            with system.open_input_stream(x.path) as source:
                head = b""
                while b"\n" not in head and (more := source.read(65_536)):
                    head += more
            if head:
                return names_of(head.split(b"\n")[0].decode().removesuffix("\r"))
        return []

    def _wanted(self) -> list[str]:
        chosen = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return chosen or ["file", "offset", *self._header()]

    def schema(self) -> StructType:
        return StructType([StructField(c, LongType() if c == "offset" else StringType()) for c in self._wanted()])

    def reader(self, schema: StructType) -> TidyReader:
        return TidyReader(self.options["path"], self.options.get("where", ""), schema.names, int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TidyWords)
