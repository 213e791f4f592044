"""Importance resampling towards a target: hashed n-grams, whose CRC-32 is composed and never computed on their text.

crc(A + B) = shift(crc(A), length of B) xor crc(B), where the shift by one byte is a linear map over GF(2).
The maps of 1, 2, 4, ... bytes are built by squaring; a shift by any length applies those of its binary
digits. So a word's CRC is computed once a task (memo), and runs of words joined by one space get theirs
from their words' CRCs and lengths, in numpy, for whole texts at once.

Counts of buckets are summed in tasks first: a task gives at most `buckets` rows. The table of gains has
one entry a bucket and goes to all tasks. The draw needs no global sort of all rows: scores are integers in
a narrow range, so a histogram of them gives the score from which rows can be drawn, and only those rows
are sorted, by range; a row's rank is its place in its range plus the sizes of the ranges before.

Defined results: a text that is null, empty or without words has no features and weight 0; a null id is
hashed as the empty text and comes last among ties; repeated rows each give one row and are ranked by
their own; ties of score and id go to fewer features, then smaller weights; with an empty target all
counts of it are 0; an empty table gives an empty result. Outputs hold the id and new columns only, so
extra columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.carry import Batches, map_texts, pieces
from graphloom.session import written

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Words whose CRC a task keeps before the memo starts anew.
MEMO = 200_000
#: Binary digits of a shift's length in bytes.
DIGITS = 40


def _operators() -> np.ndarray:
    """Byte tables (digit, byte of the CRC, value) of the shifts by 2^digit zero bytes."""
    columns = np.array([0xEDB88320, *(1 << np.arange(31))], np.uint64)  # by one zero bit

    def through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bitwise_xor.reduce(np.where(x[:, None] >> np.arange(32, dtype=np.uint64) & np.uint64(1), table, np.uint64(0)), 1)

    for _ in range(3):
        columns = through(columns, columns)
    tables = []
    for _ in range(DIGITS):
        tables.append([through(columns, np.arange(256, dtype=np.uint64) << np.uint64(8 * k)) for k in range(4)])
        columns = through(columns, columns)
    return np.array(tables, np.uint64)


_SHIFTS = _operators()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs' share in the CRC of a text that goes on for `length` bytes."""
    crc = crc.copy()
    for digit in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> np.uint64(digit) & np.uint64(1))
        x, table = crc[on], _SHIFTS[digit]
        crc[on] = table[0][x & np.uint64(255)] ^ table[1][x >> np.uint64(8) & np.uint64(255)] ^ table[2][x >> np.uint64(16) & np.uint64(255)] ^ table[3][x >> np.uint64(24)]
    return crc


class Memo(dict):
    """CRC of a word in the low 32 bits, its length above."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = value = zlib.crc32(word) | len(word) << 32
        return value


def features(text: str | None, memo: Memo, longest: int = LONGEST) -> tuple[int, list[np.ndarray]]:
    """Number of words, and for each n up to `longest` the CRC-32 of every run of n words joined by one space."""
    found = WORD.findall((text or "").encode().lower())
    packed = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    crc, size = packed & np.uint64(0xFFFFFFFF), packed >> np.uint64(32)
    runs = [crc]
    if longest > 1 and len(found) > 1:
        spaced = shift(np.full(len(crc), zlib.crc32(b" "), np.uint64), size) ^ crc
        for n in range(2, min(longest, len(found)) + 1):
            runs.append(shift(runs[-1][:-1], size[n - 1 :] + np.uint64(1)) ^ spaced[n - 1 :])
    return len(found), runs


def _counts(rows: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = Memo(), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                for t in part.column(0).to_pylist():
                    for crc in features(t, memo, longest)[1]:
                        total += np.bincount((crc % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "many"])

    found = rows.select(text).mapInArrow(run, "bucket long, many long").groupBy("bucket").agg(F.sum("many").alias("many")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:  # at most `buckets` rows
        out[r["bucket"]] = r["many"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares in target and source, by bucket."""
    n = len(source)
    total, wanted = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * total / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, keep: list, text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Columns of `keep`, then n_words, n_features and weight, the floored mean of the gains of a row's features."""
    table = gains(_counts(docs, text, longest, buckets), _counts(target, target_text, longest, buckets))

    def step(batches: Batches, n: int, names: list[str]) -> Batches:
        memo = Memo()
        for batch in batches:
            for part in pieces(batch, n):
                out = []
                for t in part.column(n).to_pylist():
                    words, runs = features(t, memo, longest)
                    many = sum(map(len, runs))
                    total = sum(int(table[(crc % np.uint64(buckets)).astype(np.int64)].sum()) for crc in runs)
                    out.append((words, many, total // many if many else 0))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], names=names)

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return map_texts(docs, keep, text, fields, step)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: key, n_features, weight, score (weight plus Gumbel noise of the id) and rank if drawn.

    Of the N documents of at least `least_words` words the floor(percent * N / 100) highest scores are drawn.
    """
    spark = docs.sparkSession
    rows = weigh(docs, target, [F.col(key).alias("id")], text, target_text, longest, buckets)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = written(rows.withColumn("score", F.col("weight") + noise).withColumn("at", F.monotonically_increasing_id()), "scores")

    fit = F.col("n_words") >= least_words
    # gains and noise are floored logarithms of 64-bit counts and 32-bit hashes: about 100,000 different scores at most
    histogram = scored.where(fit).groupBy("score").count().collect()
    draw, above, cut = percent * sum(r["count"] for r in histogram) // 100, 0, None
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if above >= draw:
            break
        above, cut = above + r["count"], r["score"]
    columns = [F.col("id").alias(key), "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = fit & (F.col("score") >= cut)
    ranges = scored.where(near).orderBy(F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight", "at")
    placed = written(ranges.withColumn("place", F.monotonically_increasing_id()), "ranges")  # the range's number above 33 bits
    part = F.shiftright("place", 33)
    starts, before = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # as many rows as ranges
        starts.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.withColumn("part", part).join(starts, "part").select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
