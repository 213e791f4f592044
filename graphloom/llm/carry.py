"""Row-wise operators in Arrow batches that carry columns of any name along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def map_texts(docs: DataFrame, keep: list[Column | str], text: str, fields: list[T.StructField], step: Callable[[Batches, int, list[str]], Batches]) -> DataFrame:
    """Columns of `keep`, then `fields`, made by step(batches, n, names) in a narrow transformation.

    A batch holds the n kept columns, then the text; step yields batches of the kept and the new columns
    under `names`. Between Spark and Python columns have neutral names, so kept ones may clash with new.
    """
    rows = docs.select(*keep, F.col(text))
    n = len(rows.columns) - 1
    plain = rows.toDF(*[f"k{i}" for i in range(n)], "t")
    schema = T.StructType([*plain.schema.fields[:n], *[T.StructField(f"v{i}", f.dataType) for i, f in enumerate(fields)]])
    names = schema.names
    return plain.mapInArrow(lambda batches: step(batches, n, names), schema).toDF(*rows.columns[:n], *[f.name for f in fields])


#: Bytes of text that are Python objects at once.
PIECE_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, column: int) -> Batches:
    """A batch in slices of about PIECE_BYTES of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PIECE_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end
