"""Vector codes: codebooks by part, and nearest entries by annular norm pruning.

A component x becomes the integer floor(256 x); vectors are cut into equal consecutive parts, each with a
codebook of integer entries. A codebook's entries are sorted by norm. A part's nearest entry is first sought
among the few entries whose norm is next to its own; as a distance is never below the difference of norms,
only entries with a norm within the best distance of the part's own norm can be nearer or tie. That interval
is found by binary search, taken inclusively (with room for rounding), and its entries are evaluated exactly,
in integers, a few on either side at a time; the better distance narrows the interval for those that are left.
Ties go to the lower index.

Codebooks are of fixed size (parts x entries) and go to all tasks; each round a task adds up its parts by
entry and gives one row per component of a codebook, whatever its number of vectors.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; rows of
another length than the most frequent one (ties: the longer) have no code and no error, count 0 in sums and
teach nothing; if the length doesn't divide, the first parts are longer by one; with fewer rows than entries codebooks are
smaller; repeated rows and ids each count; rows with a null id are coded, their id comes last; components
are taken as at most the largest whose squared distances fit a long; sums of errors beyond a long stay at
its largest value; an empty table gives an empty result. Outputs hold the id and new columns only, so extra
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hot import join_hot
from graphloom.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries next in norm that give the first best distance, entries on either side by which the search goes on, and
#: numbers that are compared at once.
FIRST, STEP, BLOCK = 4, 6, 4_000_000
LARGEST = 2**63 - 1


class Book:
    """Entries of one part, by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def _evaluated(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least distance, and lowest index that has it, among the entries begin..end (by norm, one at least) of each row."""
        many = end - begin
        first = np.cumsum(many) - many
        row = np.repeat(np.arange(len(rows)), many)
        entry = np.arange(len(row)) - np.repeat(first - begin, many)
        gap = rows[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        best = np.minimum.reduceat(distance, first)
        return best, np.minimum.reduceat(np.where(distance == best[row], self.order[entry], len(self.order)), first)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, and the squared distance."""
        step = max(1, BLOCK // max(1, self.entries.size))
        found = [self._nearest(rows[at : at + step]) for at in range(0, len(rows), step)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, m = np.sqrt((rows.astype(np.float64) ** 2).sum(1)), len(self.norms)
        begin = (np.searchsorted(self.norms, own) - FIRST // 2).clip(0, max(0, m - FIRST))
        end = np.minimum(begin + FIRST, m)
        best, index = self._evaluated(rows, begin, end)
        while True:
            reach = np.sqrt(best.astype(np.float64))
            reach += 1e-9 * (1 + own + reach)  # rounding never narrows the annulus
            low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
            below, above = np.maximum(low, begin - STEP), np.minimum(high, end + STEP)
            rest = [(np.flatnonzero(below < begin), below, begin.copy()), (np.flatnonzero(above > end), end.copy(), above)]
            if not any(len(on) for on, *_ in rest):
                return index, best
            for on, first, last in rest:
                if len(on):
                    distance, entry = self._evaluated(rows[on], first[on], last[on])
                    better = (distance < best[on]) | ((distance == best[on]) & (entry < index[on]))
                    best[on[better]], index[on[better]] = distance[better], entry[better]
            begin, end = np.minimum(begin, below), np.maximum(end, above)


def _integers(vectors: pa.ListArray, dims: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    limit = float(int((2**61 / max(1, dims)) ** 0.5) // 2)
    return np.floor(SCALE * flat).clip(-limit, limit).astype(np.int64)


def _parts(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(rows, parts, axis=1)


def _moved(kept: DataFrame, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """Each entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    parts, m = len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Book(b) for b in books]
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], np.zeros((parts, m), np.int64)
        for batch in batches:
            if batch.num_rows:
                for p, rows in enumerate(_parts(_integers(batch.column(0), dims), parts)):
                    index, _ = trees[p].nearest(rows)
                    np.add.at(sums[p], index, rows)
                    counts[p] += np.bincount(index, minlength=m)
        cells = np.concatenate([counts.ravel(), *[s.ravel() for s in sums]])
        held = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(cells[held])], names=["cell", "value"])

    cells = np.zeros(parts * m + sum(b.size for b in books), np.int64)
    for r in kept.select("vector").mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # as many rows as codebooks have numbers
        cells[r["cell"]] = r["value"]
    counts, at, out = cells[: parts * m].reshape(parts, m), parts * m, []
    for p, book in enumerate(books):
        sums = cells[at : at + book.size].reshape(book.shape)
        at += book.size
        out.append(np.where(counts[p][:, None] > 0, sums // np.maximum(counts[p], 1)[:, None], book))
    return out


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code (two hex digits per part), error, label_error (summed over equal labels) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold at most 256 entries")
    plain = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = plain.where(F.col("vector").isNotNull() & finite)
    lengths = kept.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    usual = kept.where(F.size("vector") == dims)
    first = usual.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect() if dims else []
    books = _parts(_integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dims), parts) if first else []
    for _ in range(rounds if books else 0):
        books = _moved(usual, books, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Book(b) for b in books]
        for batch in batches:
            if batch.num_rows:
                found = [trees[p].nearest(rows) for p, rows in enumerate(_parts(_integers(batch.column(2), dims), parts))]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=["id", "label", "code", "error"])

    kinds = f"id {plain.schema['id'].dataType.simpleString()}, label {plain.schema['label'].dataType.simpleString()}, code string, error long"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"))]
    coded = usual.mapInArrow(run, kinds) if books else usual.select("id", "label", *none)
    coded = coded.unionByName(kept.where(F.size("vector") != dims).select("id", "label", *none))
    coded = written(coded.withColumn("group", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))), "codes")
    wide = F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = written(coded.groupBy("group").agg(F.least(wide, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("many")), "label_errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    out = join_hot(coded, sums, "group", "many", "id")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
