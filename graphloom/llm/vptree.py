"""Nearest neighbours by vantage-point trees per shard.

Rows fall into shards of about SHARD_BYTES by a hash of their id, each with a tree over unit vectors, on which Euclidean
distance orders like cosine. A subtree is skipped if the triangle inequality keeps it farther than the
best found so far divided by `factor`: 1 is exact, larger values skip more. Queries stream through each
shard's tree in blocks, so neither side is ever held whole; shards' results meet in a top-k by query. Where
there are fewer shards than cores, a shard's queries are dealt to several tasks that hold it.

Distances are rounded, so the trees only propose: every row within a query's k-th distance and the rounding,
however many tie there, is scored in double precision, and score and id decide. They are gathered in pieces, of
which the k best so far are kept, so memory doesn't grow with them.

Of equal vectors only the k + 1 smallest ids are searched: no query can have another one of them among
its k nearest, so nothing is lost however many copies a vector has.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an
id, take no part; vectors of another length than the query's are no candidates of it; repeated rows of
one id count once, with the least of their vectors if they differ; ties go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives an empty result; extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import written

#: Bytes of a shard's vectors, in double precision.
SHARD_BYTES = 32 << 20
LEAF = 96
#: Queries searched together.
BLOCK = 1024
#: Candidates kept beyond k; queries with more rows than these within the rounding are searched again for all of them.
SPARE = 6
#: Error of a distance, at most: the root of that of a product of unit vectors, where vectors are nearly equal.
ROUNDING = 1e-6
#: Candidates scored at once, and rows of a node that are compared with a block at once: rows of one direction can't be
#: split, however many there are. Nodes this deep aren't split any more.
PAIRS, ROWS, DEPTH = 65_536, 512, 64


class Tree:
    """Vantage-point tree over the rows of a matrix of unit vectors."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, seed: int = 1):
        self.unit, self.ids, self.rng = unit, ids, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)), 0)

    def _build(self, rows: np.ndarray, depth: int):
        if len(rows) <= LEAF or depth == DEPTH:
            return rows
        pick = int(self.rng.integers(len(rows)))
        point, rest = rows[pick], np.delete(rows, pick)
        far = self._distance(self.unit[rest], self.unit[point])
        radius = float(np.median(far))
        inside = far <= radius
        if inside.all():
            return rows  # equal distances can't be split
        return point, radius, self._build(rest[inside], depth + 1), self._build(rest[~inside], depth + 1)

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))

    def search(self, unit: np.ndarray, own: np.ndarray, keep: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distance, row) of the nearest `keep` rows of each query but those with its own id; -1 for none."""
        self.best = np.full((len(unit), keep), np.inf)
        self.row = np.full((len(unit), keep), -1)
        self.query, self.own, self.factor = unit, own, factor
        if len(self.unit):
            # first each query's own leaf, for a bound; then every node once, with all queries that it may serve
            self._visit(self.root, np.arange(len(unit)), True)
            self.limit = self.best[:, -1].copy()
            self.best[:], self.row[:] = np.inf, -1
            self._visit(self.root, np.arange(len(unit)), False)
        return self.best, self.row

    def within(self, unit: np.ndarray, own: np.ndarray, limit: np.ndarray, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all rows up to each query's limit and the rounding but those with its own id, in pieces."""
        self.query, self.own, self.factor, self.limit = unit, own, factor, limit
        return self._gather(self.root, np.arange(len(unit)))

    def _gather(self, node, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(q):
            return
        leaf = isinstance(node, np.ndarray)
        for at in range(0, len(node) if leaf else 1, ROWS):
            rows = node[at : at + ROWS] if leaf else np.array([node[0]])
            far = self._distance(self.query[q], self.unit[rows])
            a, b = np.nonzero((far <= self.limit[q, None] + ROUNDING) & (self.ids[rows][None, :] != self.own[q, None]))
            yield q[a], rows[b]
        if not leaf:
            reach, gap = self.limit[q] / self.factor + ROUNDING, far[:, 0] - node[1]
            yield from self._gather(node[2], q[gap <= reach])
            yield from self._gather(node[3], q[-gap <= reach])

    def _offer(self, q: np.ndarray, rows: np.ndarray, far: np.ndarray) -> None:
        far = np.where(self.ids[rows][None, :] == self.own[q][:, None], np.inf, far)
        near = far.min(1) < self.best[q, -1]
        if not near.any():
            return
        q, far = q[near], far[near]
        every = np.concatenate([self.best[q], far], 1)
        names = np.concatenate([self.row[q], np.broadcast_to(rows, far.shape)], 1)
        order = np.argsort(every, 1, kind="stable")[:, : self.best.shape[1]]
        self.best[q] = np.take_along_axis(every, order, 1)
        self.row[q] = np.where(np.isinf(self.best[q]), -1, np.take_along_axis(names, order, 1))

    def _visit(self, node, q: np.ndarray, home: bool) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), ROWS):
                rows = node[at : at + ROWS]
                self._offer(q, rows, self._distance(self.query[q], self.unit[rows]))
            return
        point, radius, inner, outer = node
        far = self._distance(self.query[q], self.unit[point][None, :])
        self._offer(q, np.array([point]), far)
        gap = far[:, 0] - radius
        self._visit(inner, q[gap <= (0 if home else self._reach(q))], home)
        self._visit(outer, q[gap > 0 if home else -gap <= self._reach(q)], home)

    def _reach(self, q: np.ndarray) -> np.ndarray:
        return np.minimum(self.limit[q], self.best[q, -1]) / self.factor + ROUNDING


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def _found(tree: Tree, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
    unit = _unit(queries)
    far, rows = tree.search(unit, own, k + SPARE, factor)
    crowded = np.flatnonzero(np.isfinite(far[:, -1]) & (far[:, -1] <= far[:, k - 1] + 2 * ROUNDING))
    rows[crowded] = -1
    q, place = np.nonzero(rows >= 0)
    best = _best((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), tree, vectors, queries, [(q, rows[q, place])], k)
    if len(crowded):
        tied = ((crowded[a], b) for a, b in tree.within(unit[crowded], own[crowded], far[crowded, k - 1] + ROUNDING, factor))
        best = _best(best, tree, vectors, queries, tied, k)
    q, found, score = best
    return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])


def _best(best: tuple[np.ndarray, np.ndarray, np.ndarray], tree: Tree, vectors: np.ndarray, queries: np.ndarray, pieces: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best by score and id per query, among `best` and the pieces' (query, row); few at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged(best):
        q, r = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        for c in range(0, len(q), PAIRS):
            part, row = q[c : c + PAIRS], r[c : c + PAIRS]
            q_, id_, score = (np.append(x, y) for x, y in zip(best, (part, tree.ids[row], cosine(queries[part], vectors[row])), strict=True))
            order = np.lexsort((id_, -score, q_))
            order = order[np.arange(len(order)) - np.searchsorted(q_[order], q_[order]) < k]
            best = q_[order], id_[order], score[order]
        return best

    for piece in pieces:
        held.append(piece)
        if sum(len(q) for q, _ in held) >= PAIRS:
            best = merged(best)
    return merged(best) if held else best


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", column: str = "embedding", factor: float = 1.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row that is_query selects."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), is_query.alias("asked")).where(F.col("id").isNotNull() & good)
    rows = written(rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asked").alias("asked")), "vectors")
    # of equal vectors only the smallest ids can be found; tasks drop the others before the shuffle
    copy = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    reps = written(rows.select("id", "v").withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    shards = max(1, -(-8 * (reps.agg(F.sum(F.size("v"))).first()[0] or 0) // shard_bytes))
    deals = max(1, -(-vectors.sparkSession.sparkContext.defaultParallelism // shards))
    cell = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int") * deals
    stored = reps.select(F.explode(F.sequence(cell, cell + (deals - 1))).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    deal = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(deals)).cast("int")
    asked = rows.where("asked").select(F.explode(F.sequence(deal, deal + (shards - 1) * deals, F.lit(deals))).alias("shard"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], {}
        for batch in batches:
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if place[begin] != shard:
                    shard, held, trees = place[begin], [], {}
                if kind[begin] == 0:
                    held.append(part)
                    continue
                if held:
                    for size, (ids, vs) in _by_length(held).items():
                        trees[size] = (Tree(_unit(vs), ids), vs)
                    held = []
                for size, (ids, vs) in _by_length([part]).items():
                    if size in trees:
                        for at in range(0, len(ids), BLOCK):
                            yield _found(*trees[size], vs[at : at + BLOCK], ids[at : at + BLOCK], k, factor)

    both = stored.unionByName(asked).repartition(min(shards * deals, 10_000), "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of vectors of equal length."""
    sizes = np.concatenate([np.diff(p.column(3).offsets.to_numpy()) for p in parts])
    ids = np.concatenate([p.column(2).to_numpy() for p in parts])
    flat = np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
    start = np.cumsum(sizes) - sizes
    return {int(n): (ids[sizes == n], flat[start[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)}
