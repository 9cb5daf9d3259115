"""Python functions over rows in small slices, so that a worker's memory follows the longest row and not the number of rows in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Bytes of text, or elements of lists, of a slice; a longer row is a slice of its own.
WEIGHT = 16_384


def _weights(a: pa.Array) -> np.ndarray:
    size = pc.binary_length(a) if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else pc.list_value_length(a)
    return np.asarray(pc.fill_null(size, 0)).astype(np.int64)


def mapped(df: DataFrame, out: str, kind: str, fn: Callable[[list], list], given: Column) -> DataFrame:
    """df with the column out of type kind: fn takes the values of given, a string or an array, of some rows, and returns as many.

    The rows are dealt over all tasks first: they are few bytes in few files, and fn is the work.
    """
    keep = len(df.columns)
    schema = StructType([*df.schema.fields, StructField(out, _parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = to_arrow_schema(schema)
        for b in batches:
            place = np.cumsum(_weights(b.column(keep)) + 1)
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(place, (place[at - 1] if at else 0) + WEIGHT, "right")))
                part = b.slice(at, end - at)
                made = pa.array(fn(part.column(keep).to_pylist()), whole.field(keep).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], made], whole.names)
                at = end

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.select("*", given.alias("_given")).repartition(n).mapInArrow(run, schema)
