"""Scores of whole documents under a gated recurrent language model, in numpy.

One pass turns the texts into blocks: token positions in the block's own vocabulary and that vocabulary with
its counts over training texts. Word counts then meet by word over all documents
(each block sends a word once) and go back to the blocks, in which documents are scored; texts aren't
shuffled, and nothing of the vocabulary's size is broadcast.

The model is a GRU with a class-factored softmax: the most frequent words have classes of WITHIN words
each with a learned distribution; all others fall into classes by their ending, within which words have
their smoothed share of the counts. It is trained by truncated backpropagation with Adam on every token of
every training text: blocks are read where they lie, shards of them train from the current weights, and
the mean of their weights (added in a tree of fixed fan-in) starts the next round. Each round takes its own share of the documents, so all
rounds together are one pass; only shards too small for LEAST_STEPS steps are read more than once.
State is carried across windows, from a document's first token
to its last, in training and in scoring.

`score` is a probability over the words of the training texts and one unknown word per class of endings: of
several unknown words that share a class each gets the probability of that one.

Words are known by 64-bit hashes; two of a billion words share one with a chance of about 3 %.

Defined results: a null text counts as empty and is one token, the end; rows with a null id belong to
crc32 of the empty text; repeated rows are scored one by one; without training texts, counts are 0 and
the weights those of the start; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hot import join_hot
from graphloom.session import written

BLOCK_TOKENS = 2_200_000
#: Tokens from which a task's blocks make a shard (the last takes what is left, too); rounds of averaging.
SHARD_TOKENS, ROUNDS, RATE = BLOCK_TOKENS, 3, 6e-3
#: Shards whose weights are added together at a time.
FAN_IN = 64
#: Steps of a shard and round: small shards are passed over again to reach the first, lanes widen beyond the second.
LEAST_STEPS, STEPS = 64, 180
CLASSES, WITHIN, ENDINGS = 32, 32, 32
TOP = CLASSES * WITHIN
HIDDEN = 32
WINDOW, LANES = 32, 256
#: Lanes in training, at least and at most.
TRAIN_LANES = 16, 128
#: Weights that are updated at a time, so that they stay in a core's cache.
PIECE = 1 << 14
MEMO = 300_000
#: Words that most blocks have, whose counts are broadcast; the others meet by a shuffle.
HOT_WORDS = 20_000
END = 0x656E64
POSITIONS = 24


class _Memo(dict):
    """Hash of a word."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def endings(self, hashes: np.ndarray) -> np.ndarray:
        """Classes of ending of ascending hashes; 0 for those of no word here."""
        found = np.zeros(len(hashes), np.uint8)
        if self and len(hashes):
            tails = np.frombuffer(b"".join([w[-3:].ljust(3, b"\0") for w in self]), np.uint8).reshape(-1, 3)
            known = np.fromiter(self.values(), np.uint64, len(self))
            place = np.minimum(np.searchsorted(hashes, known), len(hashes) - 1)
            here = hashes[place] == known
            found[place[here]] = tails[here].astype(np.uint64) @ np.array([1, 1 << 8, 1 << 16], np.uint64) * np.uint64(2654435761) // np.uint64(65536) % np.uint64(ENDINGS)
        return found


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased in A-Z; the end isn't among them."""
    return (text or "").encode().lower().split()


def _pack(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, 5))


def _unpack(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _planes(a: np.ndarray) -> bytes:
    """uint32 values as four byte planes, which compress better."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_BLOCK = "block long, vocabulary binary, docs binary"


def _blocks(docs: DataFrame, key: str, text: str, train: Column, block_tokens: int) -> DataFrame:
    """One row per block. vocabulary: hashes, ending classes, training counts; docs: ids, folds, lengths, positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for i, trains, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ws = words(t.as_py())
                h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
                ids.append(i)
                held.append(not trains)
                tokens.append(np.append(h, np.uint64(END)))
                total += len(h) + 1
                if total >= block_tokens:
                    yield _block((part << 12) + number, ids, held, tokens, memo)
                    ids, held, tokens, total, number = [], [], [], 0, number + 1
                    if len(memo) > MEMO:
                        memo = _Memo()
        if ids:
            yield _block((part << 12) + number, ids, held, tokens, memo)

    return docs.select(F.col(key).cast("long").alias("i"), train.alias("trains"), F.col(text)).mapInArrow(run, _BLOCK)


def _block(block: int, ids: list, held: list, tokens: list[np.ndarray], memo: _Memo) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    known, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # frequent words get small positions
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[place]
    trains = np.repeat(~np.array(held), lengths)
    n = np.bincount(place[trains], minlength=len(known))
    row = [(known[order], memo.endings(known)[order], n), (ids, held, lengths, _planes(place))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in row)], names=["block", "vocabulary", "docs"])


def _lessons(vocabulary: bytes, docs: bytes, top: dict[int, int], turn: int, rounds: int) -> list[np.ndarray]:
    """Model ids of a block's training documents whose turn is this round; each has one turn."""
    h, endings, _ = _unpack(vocabulary)
    ids, held, lengths, planes = _unpack(docs)
    model_id = endings.astype(np.int64) + TOP
    words_, numbers = (np.fromiter(x, t, len(top)) for x, t in ((top.keys(), np.uint64), (top.values(), np.int64)))
    _, here, which = np.intersect1d(h, words_, assume_unique=True, return_indices=True)
    model_id[here] = numbers[which]
    place, start = _from_planes(planes), np.cumsum(lengths) - lengths
    mine = [k for k, i in enumerate(ids) if not held[k] and xxhash.xxh3_64_intdigest(f"{i} {k}".encode()) % rounds == turn]
    return [model_id[place[start[k] : start[k] + lengths[k]]] for k in mine]


def _words(blocks: DataFrame) -> DataFrame:
    """(at, word, ending, n) for each word of each block; at holds the block and the position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, endings, n = _unpack(raw)
                if len(h) > 1 << POSITIONS:  # positions would run into the next block's
                    raise ValueError(f"a block of {len(h):,} different words; at most {1 << POSITIONS:,} fit")
                for k in range(0, len(h), 100_000):
                    s = slice(k, k + 100_000)
                    at = (block << POSITIONS) + np.arange(len(h))[s]
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(h[s].astype(np.int64)), pa.array(endings[s].astype(np.int32)), pa.array(n[s].astype(np.int64))], names=["at", "word", "ending", "n"])

    return blocks.select("block", "vocabulary").mapInArrow(run, "at long, word long, ending int, n long")


def _softmax_parts(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and those's sums by row, shifted by the rows' maxima if they would leave float32."""
    e = np.exp(logit) if logit.size and logit.max() < 60 else None
    total = None if e is None else e @ np.ones(e.shape[1], np.float32)
    if total is None or total.min() < 1e-25:
        logit = logit - logit.max(1, keepdims=True)
        e = np.exp(logit)
        total = e.sum(1)
    return logit, e, total


def _slopes(e: np.ndarray, total: np.ndarray, lane: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradients of the targets' log-probabilities by the logits, in the place of their exponentials."""
    e *= -1 / total[:, None]
    e[lane, target] += 1
    return e


class Model:
    """Parameters and passes of the GRU; inputs and outputs are model ids.

    An id below TOP is a word, class id // WITHIN; TOP + e is any other word with ending class e.
    """

    SHAPES = {"enter": (TOP + ENDINGS, 3 * HIDDEN), "again": (HIDDEN, 3 * HIDDEN), "shift": (HIDDEN,), "classes": (HIDDEN, CLASSES + ENDINGS), "class_shift": (CLASSES + ENDINGS,), "words": (CLASSES, HIDDEN, WITHIN), "word_shift": (CLASSES, WITHIN)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat is None:
            flat = (np.random.default_rng(seed).standard_normal(size) * 0.1).astype(np.float32)
        self.flat, self.p, at = np.array(flat, np.float32), {}, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.p[name] = self.flat[at : at + n].reshape(shape)
            at += n

    def outputs(self, hidden: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target's class and, for words, within it; gradients of the sum if asked."""
        cls = np.where(y < TOP, y // WITHIN, y - TOP + CLASSES)
        order = np.argsort(cls.astype(np.uint8), kind="stable")  # words first, by class
        hidden, y, cls, lane = hidden[order], y[order], cls[order], np.arange(len(y))
        logit = hidden @ self.p["classes"]
        logit += self.p["class_shift"]
        logit, e, total = _softmax_parts(logit)
        logs = logit[lane, cls].astype(np.float64) - np.log(total)
        back = None
        if grads is not None:
            g = _slopes(e, total, lane, cls)
            back = g @ self.p["classes"].T
            grads["classes"] += hidden.T @ g
            grads["class_shift"] += np.ones(len(g), np.float32) @ g
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        n, here = edges[-1], [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
        if n:
            lane, w, logit = lane[:n], y[:n] % WITHIN, np.empty((n, WITHIN), np.float32)
            for c, mine in here:
                np.matmul(hidden[mine], self.p["words"][c], out=logit[mine])
            logit += self.p["word_shift"][cls[:n]]
            logit, e, total = _softmax_parts(logit)
            logs[:n] += logit[lane, w] - np.log(total)
            if grads is not None:
                g, within = _slopes(e, total, lane, w), np.empty((n, HIDDEN), np.float32)
                for c, mine in here:
                    np.matmul(g[mine], self.p["words"][c].T, out=within[mine])
                    grads["words"][c] += hidden[mine].T @ g[mine]
                back[:n] += within
                grads["word_shift"][[c for c, _ in here]] += np.add.reduceat(g, [mine.start for _, mine in here])
        out = np.empty_like(logs)
        out[order] = logs
        if back is None:
            return out, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return out, unsorted

    def _forward(self, a: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
        """States before and after each step of a window (time, lane) from the inputs' rows of `enter`, which it overwrites; gates,
        candidates and inner parts of each step, or of the last one only."""
        steps, width, _ = a.shape
        kept, again, one = steps if keep else 1, self.p["again"].copy(), np.ones((), np.float32)
        for negated in (a[..., : 2 * HIDDEN], again[:, : 2 * HIDDEN]):
            np.negative(negated, out=negated)
        shift, b = np.tile(self.p["shift"], (width, 1)), np.empty((width, 3 * HIDDEN), np.float32)
        states, gates, news, inners = (np.empty((n, width, k * HIDDEN), np.float32) for n, k in ((steps + 1, 1), (kept, 2), (kept, 1), (kept, 1)))
        states[0] = h
        h, b_gates, b_new = states[0], b[:, : 2 * HIDDEN], b[:, 2 * HIDDEN :]
        for t in range(steps):
            k, now, after = t if keep else 0, a[t], states[t + 1]
            g, n, inner = gates[k], news[k], inners[k]
            np.matmul(h, again, out=b)
            np.add(b_gates, now[:, : 2 * HIDDEN], out=g)
            np.exp(g, out=g)
            np.add(g, one, out=g)
            np.reciprocal(g, out=g)
            np.add(b_new, shift, out=inner)
            np.multiply(g[:, HIDDEN:], inner, out=n)
            np.add(n, now[:, 2 * HIDDEN :], out=n)
            np.tanh(n, out=n)
            np.subtract(h, n, out=after)
            np.multiply(after, g[:, :HIDDEN], out=after)
            np.add(after, n, out=after)
            h = after
        return states, gates, news, inners

    def _step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from the inputs' rows of `enter`: the state, gates, candidate and inner part."""
        states, gates, news, inners = self._forward(a[None].copy(), h, True)
        return states[1], gates[0], news[0], inners[0]

    def window(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states of a window (time, lane) and the last of them."""
        states = self._forward(self.p["enter"].take(x, 0), h, False)[0]
        return states[1:], states[-1]

    def learn(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean log-probability over one window, the state after it, and that mean."""
        grads = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items()}
        h, total = self._gradients(x, y, mask, h, grads)
        n_tokens = max(1, int(mask.sum()))
        return {k: g / n_tokens for k, g in grads.items()}, h, total / n_tokens

    def _gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray, grads: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
        """Adds the gradients of the summed log-probability over one window to zeros; the state after it, and that sum."""
        states, gates, n, inner = self._forward(self.p["enter"].take(x, 0), h, True)
        steps, width = x.shape
        logs, back = self.outputs(states[1:][mask], y[mask], grads)
        from_out = np.zeros((steps, width, HIDDEN), np.float32)
        from_out[mask] = back
        # all parts of a step's gradient are multiples of its state's: of the recurrent candidate, both gates, the candidate
        z, r = np.ascontiguousarray(gates[..., :HIDDEN]), gates[..., HIDDEN:]
        parts = np.empty((steps, width, 4, HIDDEN), np.float32)
        dn = np.multiply(n, n, out=parts[:, :, 3])
        np.subtract(1, dn, out=dn)
        keep = 1 - z
        dn *= keep
        again_n = np.multiply(dn, r, out=parts[:, :, 0])
        dz = np.subtract(states[:-1], n, out=parts[:, :, 1])
        dz *= z
        dz *= keep
        dr = np.subtract(1, r, out=parts[:, :, 2])
        dr *= inner
        dr *= again_n
        again = self.p["again"]
        back_again = np.concatenate([again[:, 2 * HIDDEN :], again[:, : 2 * HIDDEN]], 1).T.copy()
        carry, dh = np.zeros((width, HIDDEN), np.float32), np.empty((width, 1, HIDDEN), np.float32)
        flat_dh, recurrent = dh[:, 0], parts.reshape(steps, width, 4 * HIDDEN)[..., : 3 * HIDDEN]
        for t in range(steps - 1, -1, -1):
            np.add(from_out[t], carry, out=flat_dh)
            np.multiply(parts[t], dh, out=parts[t])
            np.matmul(recurrent[t], back_again, out=carry)
            np.multiply(flat_dh, z[t], out=flat_dh)
            np.add(carry, flat_dh, out=carry)
        flat = parts.reshape(-1, 4 * HIDDEN)
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        inputs = x.ravel()[order]
        first = np.flatnonzero(np.diff(inputs, prepend=-1))
        grads["enter"][inputs[first]] = np.add.reduceat(flat.take(order, 0)[:, HIDDEN:], first)
        recur = states[:-1].reshape(-1, HIDDEN).T @ flat[:, : 3 * HIDDEN]
        grads["again"][:, : 2 * HIDDEN], grads["again"][:, 2 * HIDDEN :] = recur[:, HIDDEN:], recur[:, :HIDDEN]
        grads["shift"][:] = np.ones(len(flat), np.float32) @ flat[:, :HIDDEN]
        return states[-1], float(logs.sum())

    def train(self, docs: list[np.ndarray], end: int, rate: float) -> Model:
        """Truncated backpropagation over all documents, which lanes read one after the other."""
        # Adam; m and v are kept as sums without their weights 0.1 and 0.01
        m, v, step, slope = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, Model(np.zeros_like(self.flat))
        g, pieces = slope.flat, [slice(k, k + PIECE) for k in range(0, len(self.flat), PIECE)]
        size = sum(map(len, docs))
        width = min(TRAIN_LANES[1], max(TRAIN_LANES[0], size // (WINDOW * STEPS)))
        for _ in range(-(-LEAST_STEPS // max(1, size // (WINDOW * width)))):
            states = _States()
            for x, y, mask, here in lanes(docs, width, WINDOW, end):
                g.fill(0)
                h, _ = self._gradients(x, y, mask, states.take(here), slope.p)
                states.update(zip(here, h, strict=True))
                n_tokens = max(1, int(mask.sum()))
                g *= min(1.0, 1.0 / (np.sqrt(float(g @ g)) / n_tokens + 1e-12)) / n_tokens
                step += 1
                spread = np.sqrt(0.01 / (1 - 0.99**step))
                for piece in pieces:
                    flat, gp, mp, vp = (x[piece] for x in (self.flat, g, m, v))
                    mp *= 0.9
                    mp += gp
                    gp *= gp
                    vp *= 0.99
                    vp += gp
                    np.sqrt(vp, out=gp)
                    gp += 1e-6 / spread
                    np.divide(mp, gp, out=gp)
                    gp *= rate * 0.1 / (1 - 0.9**step) / spread
                    flat += gp
        return self


def lanes(docs: list[np.ndarray], width: int, window: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Windows (time, lane) of inputs, targets and mask, and the document in each lane, longest first.

    A document keeps its lane from window to window; a finished one gives its place to the next.
    """
    waiting = sorted(range(len(docs)), key=lambda k: len(docs[k]))
    mine: list[list[int]] = []  # document and position of each lane
    while True:
        mine = [m for m in mine if m[1] < len(docs[m[0]])]
        while len(mine) < width and waiting:
            mine.append([waiting.pop(), 0])
        if not mine:
            return
        x = np.full((window, len(mine)), end, np.int64)
        y, mask = x.copy(), np.zeros(x.shape, bool)
        for lane, m in enumerate(mine):
            doc, at = docs[m[0]], m[1]
            n = min(window, len(doc) - at)
            y[:n, lane], mask[:n, lane] = doc[at : at + n], True
            x[1:n, lane] = doc[at : at + n - 1]
            if at:
                x[0, lane] = doc[at - 1]
            m[1] += n
        yield x, y, mask, [m[0] for m in mine]


class _States(dict):
    """State of each document that has begun; zeros for the others."""

    def take(self, here: list[int]) -> np.ndarray:
        return np.stack([self.pop(d, _START) for d in here])


_START = np.zeros(HIDDEN, np.float32)


def log_likelihoods(model: Model, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-probability of each document's model ids."""
    out, states = np.zeros(len(docs)), _States()
    for x, y, mask, here in lanes(docs, LANES, WINDOW, end):
        hidden, h = model.window(x, states.take(here))
        states.update(zip(here, h, strict=True))
        logs, _ = model.outputs(hidden[mask], y[mask])
        out += np.bincount(np.broadcast_to(np.array(here), mask.shape)[mask], logs, len(docs))
    return out


def _shards(lessons: Iterator[tuple[int, list[np.ndarray]]], least: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first block, tokens, documents) of shards of `least` tokens or more from blocks' documents.

    What is left joins the shard before it: a shard takes at least the steps of its longest document, however small it is.
    """
    shards: list[tuple[int, int, list[np.ndarray]]] = []
    for block, docs in lessons:
        if not shards or shards[-1][1] >= least:
            shards.append((block, 0, []))
        first, size, others = shards.pop()
        shards.append((first, size + sum(map(len, docs)), others + docs))
        if len(shards) > 1 and shards[-1][1] >= least:
            yield shards.pop(0)
    if len(shards) > 1:
        (first, size, docs), (_, n, more) = shards
        shards = [(first, size + n, docs + more)]
    if shards and shards[0][1]:
        yield shards[0]


def _federated(blocks: DataFrame, model_ids: dict[int, int], shard_tokens: int, rounds: int) -> np.ndarray:
    """Weights after rounds of local training on shards of all blocks and averaging."""
    context = blocks.sparkSession.sparkContext
    top = context.broadcast(model_ids)
    flat = Model().flat
    for turn in range(rounds):
        start = context.broadcast(flat)

        def local(batches: Iterator[pa.RecordBatch], turn: int = turn, start=start) -> Iterator[pa.RecordBatch]:
            def lessons() -> Iterator[tuple[int, list[np.ndarray]]]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        block, vocabulary, raw = (batch.column(c)[k].as_py() for c in range(3))
                        yield block, _lessons(vocabulary, raw, top.value, turn, rounds)

            for block, size, docs in _shards(lessons(), -(-shard_tokens // rounds)):
                flat = Model(start.value).train(docs, top.value.get(END, TOP), RATE).flat.astype(np.float64)
                shard = xxhash.xxh3_64_intdigest(str(block).encode()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([float(size)]), pa.array([(flat * size).tobytes()], pa.binary())], names=["shard", "size", "flat"])

        total = _added(written(blocks.mapInArrow(local, "shard long, size double, flat binary"), "weights"))
        if total is not None:
            flat = total.astype(np.float32)
        start.unpersist()
    return flat


def _added(parts: DataFrame) -> np.ndarray | None:
    """Weighted mean of rows (shard, size, flat): sums of FAN_IN rows or so, until the driver gets as few."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(raw, np.float64) for raw in pdf["flat"]], 0)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "size": [pdf["size"].sum()], "flat": [total.tobytes()]})

    while (n := parts.count()) > FAN_IN:
        group = F.pmod(F.xxhash64("shard"), F.lit(-(-n // FAN_IN)))
        parts = written(parts.groupBy(group).applyInPandas(add, parts.schema), "weights")
    rows = sorted(parts.collect())
    return sum(np.frombuffer(r["flat"], np.float64) for r in rows) / sum(r["size"] for r in rows) if rows else None


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, sample_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    All training tokens are trained on; sample_tokens only says how many make a shard.
    """
    spark = docs.sparkSession
    blocks = written(_blocks(docs, key, text, train, block_tokens), "blocks")
    counts = written(_words(blocks).groupBy("word").agg(F.sum("n").alias("c"), F.min("ending").alias("ending"), F.count("*").alias("blocks")).where("c > 0"), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(whole["n"]), int(whole["v"])
    most = [(r["word"] & (2**64 - 1), r["c"], r["ending"]) for r in counts.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    top = {w: k for k, (w, _, _) in enumerate(most)}
    mass = {r["ending"]: r["mass"] for r in counts.groupBy("ending").agg(F.sum(F.col("c") + 1).alias("mass")).collect()}
    for _, c, e in most:
        mass[e] -= c + 1
    room = np.array([mass.get(e, 0) + 1 for e in range(ENDINGS)], np.float64)  # one more for an unknown word
    weights = _federated(blocks, top, sample_tokens, rounds)
    shared = spark.sparkContext.broadcast((weights, top, room))

    # counts go back to the blocks by word; a block's own row follows its counts
    ids = spark.createDataFrame([(int(np.uint64(w).astype(np.int64)), k) for w, k in top.items()], "word long, id int")
    rows = join_hot(_words(blocks).select("at", "word", "ending"), counts.select("word", "c", "blocks"), "word", "blocks", "at", bound=HOT_WORDS).join(F.broadcast(ids), "word", "left")
    rows = rows.select("at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("id", F.col("ending") + TOP).alias("id"), F.lit(None).cast("binary").alias("docs"))
    last = (1 << POSITIONS) - 1
    ends = blocks.select((F.shiftleft("block", POSITIONS) + last).alias("at"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("id"), "docs")
    parts = int(min(100_000, max(1, 2 * blocks.count())))
    both = rows.unionByName(ends).repartition(parts, F.shiftright("at", POSITIONS)).sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ids, room = shared.value
        model, end = Model(flat), ids.get(END, TOP)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            docs_at = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            begin = 0
            for stop in [*docs_at, batch.num_rows]:
                held.append(tuple(batch.column(k).slice(begin, stop - begin).to_numpy() for k in (1, 2)))
                begin = stop + 1
                if stop < batch.num_rows:
                    c, model_id = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    yield _scores(model, end, room, n, v, c, model_id.astype(np.int64), _unpack(batch.column(3)[int(stop)].as_py()))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def _scores(model: Model, end: int, room: np.ndarray, n: int, v: int, c: np.ndarray, model_id: np.ndarray, docs: tuple) -> pa.RecordBatch:
    """Scores of a block's documents from the counts and model ids of its words."""
    ids, held, lengths, planes = docs
    place = _from_planes(planes)
    base = np.log10((c + 1) / (n + v + 1))
    share = np.where(model_id >= TOP, np.log((c + 1) / room[np.maximum(model_id - TOP, 0)]), 0)  # of a word within its ending class
    start = np.cumsum(lengths) - lengths
    base_score, known, within = (np.add.reduceat(x[place], start) for x in (base, (c > 0).astype(np.int64), share))
    whole = model_id[place]
    score = (log_likelihoods(model, [whole[s : s + k] for s, k in zip(start, lengths, strict=True)], end) + within) / np.log(10)
    arrays = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base_score), pa.array(score)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
