"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

A window is ITEM_WINDOW consecutive words of an item (the whole item if it has fewer). For exact
containment the necessary prefix of a window is one shingle; shingles are ordered by their rarity over
all documents, so the rarest of a window is joined. A match at a document's word fixes where the window
would start: that start must be at or after word 0 and leave room for the window's length (positional
and length bound); then all words are compared, first by 64-bit hashes, then letter by letter.

The benchmark is the stated query set: it is taken in blocks of at most BLOCK_WORDS words (an item that is
longer is cut into overlapping parts) and each block is broadcast. However many blocks there are, documents
are passed over twice: once to count the shingles of all blocks, once to find the windows of all blocks. A
task holds a few megabytes of documents and one block at a time.

Defined results: a null or wordless text has no words and no hits; items without id or words can't
occur; rows of the benchmark that share an id are one item; repeated documents are judged one by one;
outputs are built from the columns asked for, so extra columns may have any name. Two words of one block
that share a hash (a chance of 3e-8 for a million words) raise; another seed then helps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.carry import pieces
from graphloom.session import written

ITEM_WINDOW = 10
#: Words of a shingle; windows with fewer words are one shingle.
SHINGLE = 3
#: Benchmark words in a broadcast block.
BLOCK_WORDS = 1_000_000
#: Words of documents that meet the blocks together.
LOOKUP_WORDS = 500_000
#: Words whose hashes a task keeps before it starts anew.
MEMO = 200_000

#: Lower-cases A-Z, keeps 0-9, a-z and bytes from 0x80, makes all else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z."""
    return (text or "").encode().translate(_FOLD).split()


class _Hashes(dict):
    """64-bit hash of a word."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.seed)
        return found


class Block:
    """Distinct windows of some items over one vocabulary, in arrays; word ids start at 1, 0 is any other word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, seed: int = 0):
        self.window = window
        names = sorted({w for _, ws in items for w in ws})
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the benchmark share a hash: choose another seed")
        ids = {names[k]: i + 1 for i, k in enumerate(order)}
        self.text = b"".join(names[k] for k in order)
        self.ends = np.cumsum([0, *(len(names[k]) for k in order)])
        rows, owners, lengths = [], [], []
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        for item, ws in items:
            flat = np.fromiter(map(ids.__getitem__, ws), np.int32, len(ws))
            n = min(len(flat), window)
            part = np.zeros((len(flat) - n + 1, window), np.int32)
            part[:, :n] = np.lib.stride_tricks.sliding_window_view(flat, n)
            rows.append(part)
            lengths.append(np.full(len(part), n))
            owners.append(np.full(len(part), number[item], np.int32))
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        same, first, place = np.unique(every.view([("", np.int32)] * window).ravel(), return_index=True, return_inverse=True)
        self.rows = every[first]
        self.length = (np.concatenate(lengths) if lengths else np.zeros(0, np.int64))[first]
        owned = np.unique(np.stack([place.ravel(), np.concatenate(owners) if owners else np.zeros(0, np.int32)], 1), axis=0)
        self.owner, self.owner_at = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(same) + 1))
        self.base = np.uint64(len(names) + 1)
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})
        keys = [self.keys(self.rows[self.length >= size] if size == SHINGLE else self.rows[self.length == size], size) for size in self.sizes]
        self.shingles = np.unique(np.concatenate([k[k > 0] for k in keys])) if keys else np.zeros(0, np.uint64)

    def keys(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Shingle keys along the last axis, 0 where a word is outside the vocabulary; longer shingles have greater keys."""
        out = np.zeros((*ids.shape[:-1], max(0, ids.shape[-1] - size + 1)), np.uint64)
        whole = np.ones(out.shape, bool)
        for k in range(size):
            part = ids[..., k : k + out.shape[-1]]
            whole &= part > 0
            out = out * self.base + part.astype(np.uint64)
        return np.where(whole, out, 0)

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle as its prefix; counts follow self.shingles."""
        prefix, offset = np.zeros(len(self.rows), np.uint64), np.zeros(len(self.rows), np.int64)
        for size in self.sizes:
            here = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
            keys = self.keys(self.rows[here], size)
            rarity = np.where(keys > 0, counts[np.searchsorted(self.shingles, keys).clip(0, len(counts) - 1)], np.iinfo(np.int64).max)
            if size < SHINGLE:
                rarity[:, 1:] = np.iinfo(np.int64).max
            offset[here] = rarity.argmin(1)
            prefix[here] = keys[np.arange(len(here)), offset[here]]
        by = np.argsort(prefix, kind="stable")
        self.prefixes, self.first, self.many = np.unique(prefix[by], return_index=True, return_counts=True)
        self.by, self.offset = by, offset

    def ids(self, docs: Docs) -> np.ndarray:
        """Word ids of documents, 0 after each."""
        at = np.searchsorted(self.hashes, docs.hashes).clip(0, max(0, len(self.hashes) - 1))
        ids = np.where(self.hashes[at] == docs.hashes, at + 1, 0) if len(self.hashes) else np.zeros(len(docs.hashes), np.int64)
        ids[docs.start[1:] - 1] = 0
        return ids

    def count(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in self.shingles that occur, and how often."""
        found = [np.zeros(0, np.int64)]
        for size in self.sizes:
            keys = self.keys(ids, size)
            keys = keys[keys > 0]
            at = np.searchsorted(self.shingles, keys).clip(0, len(self.shingles) - 1)
            found.append(at[self.shingles[at] == keys])
        return np.unique(np.concatenate(found), return_counts=True)

    def hits(self, docs: Docs) -> tuple[np.ndarray, np.ndarray]:
        """Verified (window, first word) pairs in concatenated documents."""
        ids, start = self.ids(docs), docs.start
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size in self.sizes:
            keys = self.keys(ids, size)
            place = np.flatnonzero(keys)
            at = np.searchsorted(self.prefixes, keys[place]).clip(0, len(self.prefixes) - 1)
            there = self.prefixes[at] == keys[place]
            place, at = place[there], at[there]
            for k in range(0, len(place), 1 << 16):
                p, a = place[k : k + (1 << 16)], at[k : k + (1 << 16)]
                n = self.many[a]
                run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = self.by[np.repeat(self.first[a], n) + run]
                p = np.repeat(p, n)
                doc = np.searchsorted(start, p, "right") - 1
                begin, length = p - self.offset[window], self.length[window]
                ok = (begin >= start[doc]) & (begin + length < start[doc + 1]) & (np.minimum(length, SHINGLE) == size)
                window, begin, length = window[ok], begin[ok], length[ok]
                column = np.arange(self.window)
                same = (ids[np.minimum(begin[:, None] + column, len(ids) - 1)] == self.rows[window]) | (column >= length[:, None])
                out.append((window[same.all(1)], begin[same.all(1)]))
        window, begin = map(np.concatenate, zip(*out, strict=True))
        return self._spelled(docs, ids, window, begin)

    def _spelled(self, docs: Docs, ids: np.ndarray, window: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose words are the window's letter by letter."""
        column = np.arange(self.window)
        inside = column < self.length[window][:, None]
        wrong = np.zeros(len(ids), bool)
        doc, split = -1, []
        for p in np.unique((begin[:, None] + column)[inside]).tolist():
            if p >= docs.start[doc + 1] or doc < 0:
                doc = int(np.searchsorted(docs.start, p, "right")) - 1
                split = words(docs.texts[doc])
            i = ids[p]
            wrong[p] = split[p - docs.start[doc]] != self.text[self.ends[i - 1] : self.ends[i]]
        bad = (wrong[np.minimum(begin[:, None] + column, len(ids) - 1)] & inside).any(1)
        return window[~bad], begin[~bad]


class Docs:
    """Some documents' texts, the hashes of their words with a 0 after each document, and where each starts."""

    def __init__(self, texts: list[str | None], hashes: list[np.ndarray]):
        self.texts = texts
        self.sizes = [len(h) for h in hashes]
        self.start = np.cumsum([0, *(n + 1 for n in self.sizes)])
        self.hashes = np.zeros(self.start[-1], np.uint64)
        for h, s in zip(hashes, self.start, strict=False):
            self.hashes[s : s + len(h)] = h


def blocks(benchmark: DataFrame, item: str, text: str, window: int, limit: int = BLOCK_WORDS, seed: int = 0) -> Iterator[Block]:
    """The benchmark in blocks; one block is on the driver at a time."""
    some: list[tuple[str, list[bytes]]] = []
    total = 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        ws = words(row["t"])
        step = max(1, limit - window + 1)  # parts of an item overlap by a word less than a window
        for at in range(0, max(1, len(ws) - window + 1) if ws else 0, step):
            part = ws[at : at + step + window - 1]
            if some and total + len(part) > limit:
                yield Block(some, window, seed)
                some, total = [], 0
            some.append((row["i"], part))
            total += len(part)
    if some:
        yield Block(some, window, seed)


class _Shared:
    """Broadcast blocks, used one after the other; of several only one is in a worker's memory at a time."""

    def __init__(self, spark: SparkSession):
        self.context, self.every = spark.sparkContext, []

    def add(self, block: Block) -> None:
        self.every.append(self.context.broadcast(block))

    def __getstate__(self) -> dict:
        return {"every": self.every}

    def __iter__(self) -> Iterator[Block]:
        for held in self.every:
            yield held.value
            if len(self.every) > 1:
                held.__dict__.pop("_value", None)  # read again from the worker's disk when its turn comes

    def drop(self) -> None:
        for held in self.every:
            held.unpersist()


def _groups(batches: Iterator[pa.RecordBatch], column: int, seed: int) -> Iterator[tuple[list[pa.RecordBatch], Docs]]:
    """Batches with about LOOKUP_WORDS words together, and their texts."""
    memo = _Hashes(seed)
    held: list[pa.RecordBatch] = []
    texts: list[str | None] = []
    hashes: list[np.ndarray] = []
    total = 0
    for piece in (part for whole in batches for part in pieces(whole, column)):
        held.append(piece)
        for text in piece.column(column).to_pylist():
            ws = words(text)
            texts.append(text)
            hashes.append(np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws)))
            total += len(ws)
        if total >= LOOKUP_WORDS:
            yield held, Docs(texts, hashes)
            held, texts, hashes, total = [], [], [], 0
    if held:
        yield held, Docs(texts, hashes)


def _rarity(docs: DataFrame, text: str, shared: _Shared, seed: int) -> DataFrame:
    """(block, k, c): occurrences of all blocks' shingles over all documents, from one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _groups(batches, 0, seed):
            for number, block in enumerate(shared):
                k, c = block.count(block.ids(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), number, np.int32)), pa.array(k), pa.array(c)], names=["block", "k", "c"])

    rows = docs.select(text).mapInArrow(run, "block int, k long, c long").groupBy("block", "k").agg(F.sum("c").alias("c"))
    return written(rows, "rarity")


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = ITEM_WINDOW, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Columns of `keep`, then n_words, n_hit (long) and items (sorted distinct ids as strings); no shuffle of documents."""
    spark = docs.sparkSession
    kept = docs.select(*keep).schema.fields
    n = len(kept)
    names = [f"k{i}" for i in range(n)]
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    final = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(names, kept, strict=True)), *made])

    unordered, ordered = _Shared(spark), _Shared(spark)
    for block in blocks(benchmark, item, item_text, window, block_words, seed):
        unordered.add(block)
    if unordered.every:
        rarity = _rarity(docs, text, unordered, seed)
        for number, block in enumerate(unordered):
            found = rarity.where(F.col("block") == number).select("k", "c").toPandas()  # as many rows as the block has shingles at most
            counts = np.zeros(len(block.shingles), np.int64)
            counts[found["k"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
            block.order(counts)
            ordered.add(block)
        unordered.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, some in _groups(batches, n, seed):
            ranges: list[list[int]] = [[] for _ in some.sizes]
            items: list[set[str]] = [set() for _ in some.sizes]
            for block in ordered:
                _add_hits(block, some, ranges, items)
            first = 0
            for piece in held:
                rows = slice(first, first + piece.num_rows)
                first += piece.num_rows
                hit = [_covered(size, mine) for size, mine in zip(some.sizes[rows], ranges[rows], strict=True)]
                arrays = [pa.array(some.sizes[rows], pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items[rows]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *arrays], names=final.names)

    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col(text).alias("t"))
    return rows.mapInArrow(run, final).toDF(*keep, *[f.name for f in made])


def _add_hits(block: Block, docs: Docs, ranges: list[list[int]], items: list[set[str]]) -> None:
    """Adds the hit ranges (begin, end, begin, end, ...) and items of one block to each document."""
    found, begin = block.hits(docs)
    doc = np.searchsorted(docs.start, begin, "right") - 1
    order = np.argsort(doc, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
        d = int(doc[mine[0]])
        b = begin[mine] - docs.start[d]
        ranges[d] += np.stack([b, b + block.length[found[mine]]], 1).ravel().tolist()
        for w in np.unique(found[mine]):
            items[d].update(block.items[o] for o in block.owner[block.owner_at[w] : block.owner_at[w + 1]])


def _covered(size: int, ranges: list[int] | None) -> int:
    """Words inside any of the ranges (begin, end, begin, end, ...)."""
    if not ranges:
        return 0
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, ranges[::2], 1)
    np.add.at(mark, ranges[1::2], -1)
    return int((np.cumsum(mark) > 0).sum())


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts, digest of the items and the verdict for rows of `contamination`."""
    return found.select(*keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
