"""Quality by a byte-level convolutional network in numpy.

A text's bytes fall into overlapping chunks that cover the whole document. Each byte has a learned
vector; learned filters over WIDTH bytes, STRIDE apart, are rectified and max-pooled within a chunk; a
small layer turns the pooled values into a chunk's logit; the mean logit over all chunks, weighted by
their bytes, gives one probability.

Defined results: a null or empty text is one chunk of padding and has a score too; scores depend on the
text only, so repeated rows get equal scores; without labelled rows of both kinds every score is 0.5;
outputs are built from the columns asked for, so extra columns may have any name; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from graphloom.llm.carry import map_texts, pieces
from graphloom.llm.sampling import fitted

#: Bounds of the labelled sample: rows of either label, characters of a row.
ROWS_PER_CLASS, MAX_CHARS = 1800, 12_000
CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 12, 4, 32, 16
EPOCHS, BATCH, RATE, DECAY = 8, 24, 4e-3, 1e-5
#: Share of the sample that also trains with a passage of 3 to 23 words.
PASSAGES = 0.8
#: Chunks convolved at once.
TOGETHER = 64
STEP = CHUNK - OVERLAP
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a text's bytes, zero-padded, and the bytes of each that no earlier chunk holds."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    n = max(1, -(-(len(raw) - OVERLAP) // STEP))
    padded = np.zeros(n * STEP + OVERLAP, np.uint8)
    padded[: len(raw)] = raw
    size = np.full(n, STEP, np.float32)
    size[-1] = max(1, len(raw) - (n - 1) * STEP)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP], size


class Network:
    """Parameters, forward pass and gradients; max-pooling makes gradients sparse."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": draw(256, EMBED, scale=0.5),
            "filters": draw(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "dense": draw(FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
            "dense_shift": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=0.3),
            "out_shift": np.zeros(1, np.float32),
        }

    def _columns(self, part: np.ndarray) -> np.ndarray:
        vectors = self.p["embed"][part].reshape(len(part), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * EMBED, 1)[:, :: STRIDE * EMBED]

    def pooled(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column windows, filter responses and their maxima for some chunks."""
        columns = np.ascontiguousarray(self._columns(part))
        responses = (columns.reshape(-1, WIDTH * EMBED) @ self.p["filters"]).reshape(len(part), POSITIONS, FILTERS)
        return columns, responses, np.maximum(responses.max(1) + self.p["shift"], 0)

    def head(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(best @ self.p["dense"] + self.p["dense_shift"])
        return hidden, hidden @ self.p["out"] + self.p["out_shift"]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """One logit per text."""
        parts, sizes = zip(*map(chunks, texts), strict=True)
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(texts)), count)
        size = np.concatenate(sizes).astype(np.float64)
        # always as many chunks at once, so that a chunk's rounding doesn't depend on its neighbours
        flat, held, filled = [], np.zeros((TOGETHER, CHUNK), np.uint8), 0
        for part in parts:
            at = 0
            while at < len(part):
                some = part[at : at + TOGETHER - filled]
                held[filled : filled + len(some)] = some
                at, filled = at + len(some), filled + len(some)
                if filled == TOGETHER:
                    flat.append(self.head(self.pooled(held)[2])[1])
                    filled = 0
        if filled:
            flat.append(self.head(self.pooled(held)[2])[1][:filled])
        return np.bincount(owner, np.concatenate(flat) * size, len(texts)) / np.bincount(owner, size, len(texts))

    def gradients(self, texts: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over some documents."""
        p = self.p
        count = np.fromiter(map(len, texts), np.int64, len(texts))
        owner, size = np.repeat(np.arange(len(texts)), count), np.concatenate(sizes)
        share = size / np.bincount(owner, size)[owner]
        part = np.concatenate(texts)
        tops, picked, bests = [], [], []
        for k in range(0, len(part), TOGETHER):
            columns, responses, best = self.pooled(part[k : k + TOGETHER])
            top = responses.argmax(1)
            tops.append(top)
            picked.append(columns[np.arange(len(top))[:, None], top])  # chunk, filter, window
            bests.append(best)
        top, window, best = np.concatenate(tops), np.concatenate(picked), np.concatenate(bests)
        hidden, logit = self.head(best)
        total = np.bincount(owner, logit * share, len(texts))
        gap = (1 / (1 + np.exp(-total)) - y) / len(y)
        g = (gap[owner] * share).astype(np.float32)
        out = {"out": hidden.T @ g, "out_shift": np.array([g.sum()], np.float32)}
        back = g[:, None] * p["out"] * (1 - hidden**2)
        out |= {"dense": best.T @ back, "dense_shift": back.sum(0)}
        back = (back @ p["dense"].T) * (best > 0)
        out |= {"shift": back.sum(0), "filters": np.einsum("cf,cfk->kf", back, window)}
        spread = (back[:, :, None] * p["filters"].T).reshape(-1, EMBED)
        place = (top * STRIDE)[:, :, None] + np.arange(WIDTH)
        byte = part[np.arange(len(part))[:, None, None], place].ravel()
        embed = np.stack([np.bincount(byte, spread[:, e], 256) for e in range(EMBED)], 1)
        return out | {"embed": embed.astype(np.float32)}

    def train(self, sample: list[tuple[str, int]], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        data = [(*chunks(t), y) for t, y in sample]
        # short texts are rare in a sample: passages of others stand in for them
        for t, y in sample:
            words = t.split(" ")
            size = int(rng.integers(3, 24))
            begin = int(rng.integers(0, max(1, len(words) - size)))
            if rng.random() < PASSAGES:
                data.append((*chunks(" ".join(words[begin : begin + size])), y))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, EPOCHS * -(-len(data) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(data))
            for k in range(0, len(order), BATCH):
                some = [data[i] for i in order[k : k + BATCH]]
                grads = self.gradients([c for c, _, _ in some], [s for _, s, _ in some], np.array([y for *_, y in some], np.float32))
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v2[name] = 0.99 * v2[name] + 0.01 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-7) + DECAY * self.p[name])
        return self


def fit(sample: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Parameters trained on (text, label); an all-zero head if a label is missing."""
    network = Network()
    if len({y for _, y in sample}) < 2:
        network.p["out"][:] = 0
        return network.p
    return network.train(sample).p


def score(docs: DataFrame, labels: DataFrame, train: Column, keep: list[Column | str], text: str = "text", label: str = "quality", key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Columns of `keep`, then `score`: a narrow transformation after the fit on the bounded sample."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fitted(docs, labels, label, train, fit, rows_per_class, max_chars, key, text))

    def run(batches: Iterator[pa.RecordBatch], n: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        network = Network()
        network.p = shared.value
        for batch in batches:
            for part in pieces(batch, n):
                logit = network.logits(part.column(n).to_pylist())
                found = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(found.astype(np.float64))], names=names)

    return map_texts(docs, keep, text, [T.StructField("score", T.DoubleType())], run)
