"""Bounded samples of labelled texts, for fitting the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of an id as text, modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: Column, fit: Callable[[list[tuple[str, int]]], Any], rows_per_class: int, max_chars: int, key: str = "doc_id", text: str = "text", seed: int = 7) -> Any:
    """fit((text, label) list) over at most `rows_per_class` training rows of either label, none over `max_chars`.

    Rows are taken in the order of a hash of their id, so the sample is the same at every run. The ids
    are few by that bound and broadcast; documents aren't shuffled, the bounded sample meets in one task,
    and the driver gets the fitted model only.
    """
    known = labels.where(train & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("id_"), F.col(label).cast("int").alias("y_")).distinct()
    order = F.xxhash64("id_", F.lit(seed))
    picked = known.where("y_ = 0").orderBy(order).limit(rows_per_class).unionByName(known.where("y_ = 1").orderBy(order).limit(rows_per_class))
    rows = docs.select(F.col(key).alias("id_"), F.col(text).alias("t_")).where(F.length("t_") <= max_chars).join(F.broadcast(picked), "id_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, t, y in sorted(found)]))], pa.binary())], names=["model"])

    model = rows.select("id_", "t_", "y_").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit([])
