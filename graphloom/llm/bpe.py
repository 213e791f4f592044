"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is split by the public pattern; each distinct piece is encoded once per cache. Pieces that are
not whole vocabulary entries are laid out as rows of padded matrices, one matrix per length bucket.
Each round every row merges its leftmost pair of minimum rank; ranks come from an open-addressing
hash table of pairs, rows without a mergeable pair leave the matrix (compaction).
Pieces over LONG bytes use the same rule with block minima, so a round costs the same at any length.

Defined results: a null text is encoded as an empty one (no ids, empty decoded bytes); rows are
independent, so repeats, ties and empty tables need nothing special; all input columns but the text
may be carried, whatever their names, because outputs are built from the columns asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.carry import map_texts, pieces

#: Piece length in bytes from which block minima replace the padded matrix.
LONG = 1024
#: Width of a block of minima.
BLOCK = 512
#: Distinct pieces kept per worker before the cache starts anew (memory only, results don't depend on it).
CACHE = 200_000
#: Characters from which a text is encoded in runs, and pieces of a run.
STREAMED, PIECES = 4_000_000, 500_000
#: Bytes of matrix cells handled at once.
MATRIX_CELLS = 1_000_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; its size is that of one vocabulary."""
    with open(path, "rb") as file:
        return file.read()


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], merged[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            moved = rest & ~free
            slot = np.where(moved, (slot + 1) & self.mask, slot)[rest]
            todo = todo[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged pairs, NONE where a pair can't merge or a side is padding (negative)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        found, out = self.keys[slot], self.values[slot]
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        out = np.where(found == keys, out, NONE)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out


class Codec:
    """Encoder and decoder of one rank file and one split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (np.array(x, np.int32) for x in (zip(*pairs) if pairs else ((), (), ())))
        self.pairs = PairTable(left, right, merged)
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Merges rows of one length bucket; a row is a piece, padded with -1 on the right."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max())
        live = np.arange(width) < size[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[live] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), width), NONE, np.int32)
        pair = live[:, 1:]
        rank[:, :-1][pair] = self.pairs.get(ids[:, :-1][pair], ids[:, 1:][pair])
        row = np.arange(len(pieces))
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            keep = best != NONE
            if not keep.all():
                for k in np.flatnonzero(~keep):
                    out[row[k]] = ids[k, : size[k]].copy()
                if not keep.any():
                    return out
                width = int(size[keep].max())
                row, size, at, best = row[keep], size[keep], at[keep], best[keep]
                ids, rank = ids[keep, :width], rank[keep, :width]
            lane, column = np.arange(len(row)), np.arange(width)
            # everything right of the merged pair moves one column to the left
            source = np.minimum(column + (column > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            size = size - 1
            ids[lane, at] = best
            ids[lane, size], rank[lane, size] = -1, NONE
            for left in (at - 1, at):
                here = np.flatnonzero(left >= 0)
                a, b = ids[here, left[here]], ids[here, np.minimum(left[here] + 1, width - 1)]
                there = left[here] + 1 < size[here]
                new = np.full(len(here), NONE, np.int32)
                new[there] = self.pairs.get(a[there], b[there])
                rank[here, left[here]] = new

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long row: ids stay in place, links skip merged columns."""
        n = len(piece)
        width = -(-n // BLOCK) * BLOCK
        ids = self.first[np.frombuffer(piece, np.uint8)].copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(width, NONE, np.int32)
        rank[: n - 1] = self.pairs.get(ids[:-1], ids[1:])
        blocks = rank.reshape(-1, BLOCK)
        least = blocks.min(1)
        alive = np.ones(n, bool)
        while True:
            block = int(least.argmin())
            if least[block] == NONE:
                return ids[alive]
            at = block * BLOCK + int(blocks[block].argmin())
            gone = int(after[at])
            ids[at], alive[gone], rank[gone] = rank[at], False, NONE
            after[at] = after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            for left in (int(before[at]), at):
                if left >= 0:
                    right = int(after[left])
                    rank[left] = self.pairs.get(ids[left : left + 1], ids[right : right + 1])[0] if right < n else NONE
            for b in {gone // BLOCK, block, max(0, int(before[at])) // BLOCK}:
                least[b] = blocks[b].min()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, as merges of the whole piece give them."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                out[i] = self._long(piece)
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in buckets.items():
            step = max(1, MATRIX_CELLS >> bits)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text (uint32, little-endian); of a very long text only some pieces are objects at a time."""
        short = iter(self._ids([self.pattern.findall(t) for t in texts if len(t) <= STREAMED]))
        return [next(short) if len(t) <= STREAMED else self._streamed(t) for t in texts]

    def _streamed(self, text: str) -> np.ndarray:
        found = (m.group() for m in self.pattern.finditer(text))
        parts = [np.zeros(0, "<u4")]
        while words := list(islice(found, PIECES)):
            parts += self._ids([words])
        return np.concatenate(parts)

    def _ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """Token ids of texts that are cut into the pattern's matches."""
        if len(self.code) > CACHE:
            self._clear()
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.code))
        if fresh:
            ids = self.encode_pieces([w.encode() for w in fresh])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.flat = np.concatenate([self.flat, *ids])
            self.code.update(zip(fresh, range(len(self.code), len(self.code) + len(fresh)), strict=True))
        out = []
        for words in split:
            codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
            n = self.length[codes]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.start[codes] - ends + n, n) + np.arange(total)].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of token ids."""
        return b"".join(b"".join(map(self.tokens.__getitem__, ids[k : k + PIECES].tolist())) for k in range(0, len(ids), PIECES))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process, rank file and pattern."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text", digests: bool = False) -> DataFrame:
    """Encodes and decodes every text; a narrow transformation without a shuffle.

    Returns the columns of `keep`, then n_tokens, ids (array of int), decoded (binary), or with
    `digests` n_tokens, ids_sha256, decoded_sha256. A null text counts as empty. The rank file is read
    on the driver and broadcast: its size is that of one vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch], n: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            for part in pieces(batch, n):
                counts, first, second = [], [], []
                for ids in c.encode([x or "" for x in part.column(n).to_pylist()]):
                    counts.append(len(ids))
                    decoded = c.decode(ids)
                    first.append(hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids.astype(np.int32))
                    second.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)

    return map_texts(docs, keep, text, fields, run)
