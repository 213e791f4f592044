"""Jaccard join of shingle sets, size-aware: subsets of small sets, inverted lists of large ones.

1. Documents with equal sets form a class; one set per class goes on.
2. A screen, exact for this threshold: of the tokens with the smallest hashes, a set that links with any
   other can have only so many that no other set has. Every task decides what its own rows tell (so a
   frequent token is sent once a batch); the rest meets by token. Most sets without a partner end here.
3. Small sets (by the boundary) list all subsets of the sizes that a link needs: two sets of s and t tokens
   link if and only if they have a subset of c(s, t) tokens in common. A subset's smallest holder is linked
   with its other holders, so a group of g copies gives g links, not g^2.
4. Large sets scan the inverted lists of their prefixes: tokens by frequency, rare ones first, bounded by
   sizes and positions. A list is compared with one, then two pivots first, and only across components that
   aren't connected yet; the last scan takes all pairs that are still apart. Full sets decide.
5. The boundary is the size at which the subsets listed so far and the lists scanned beyond cost least.

So every pair that links is found, or its components are already connected.

Defined results: a text that is null, empty or without words has no set, n_shingles 0 and links with
nothing; rows without an id are returned with component_id null and link with nothing; repeated rows (and
repeated ids) each give one row; outputs hold the id and new columns only, so extra columns may have any
name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import near_dups
from graphloom.llm.carry import pieces
from graphloom.llm.hot import join_hot
from graphloom.llm.near_dups import shingles
from graphloom.session import cut_lineage, written

THRESHOLD = (80, 100)
#: The boundary is sought up to this size; beyond it subsets are too many in any case.
MOST_SMALL = 20
#: Rounds with pivots before the last scan; holders of a token that meet in one place.
ROUNDS, SPLIT = 2, 500

_Batches = Iterator[pa.RecordBatch]


class Bounds:
    """What a similarity of num / den demands of set sizes, in integers."""

    def __init__(self, threshold: tuple[int, int]):
        self.num, self.den = threshold

    def partner(self, n: int) -> int:
        """The smallest partner of a set of n tokens; it is also the least they share."""
        return -(-self.num * n // self.den)

    def shared(self, s: int, t: int) -> int:
        """Tokens that sets of s and t tokens must share."""
        return -(-self.num * (s + t) // (self.num + self.den))

    def room(self, c: int) -> int:
        """The most tokens that two sets which share c may have together."""
        return c * (self.num + self.den) // self.num

    def screened(self, n: int) -> tuple[int, int]:
        """How many of a set's smallest hashes the screen takes, and how many of them others must take, too.

        Sets that link have all but n - partner(n) tokens in common, so k tokens beyond that number hold k common
        ones. A set takes a tenth of its size beyond; its smallest partner p takes a tenth of p.
        """
        p = self.partner(n)
        return min(n, n - p + max(1, -(-n // 10))), max(1, min(-(-p // 10), self.partner(p)))

    def subset_sizes(self, n: int) -> range:
        """Sizes of the subsets that a set of n tokens lists."""
        return range(self.shared(self.partner(n), n), min(n, self.shared(n, n * self.den // self.num)) + 1)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _heads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, n, digest of its set and the digest's first half as a number (null without words)."""

    def run(batches: _Batches) -> _Batches:
        memo = near_dups._Memo()
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            sets = [shingles(t, memo) for t in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield _batch(doc=batch.column(0), n=pa.array([len(s) for s in sets], pa.int64()), digest=pa.array(digests, pa.binary()), owner=pa.array([d and _short(d) for d in digests], pa.int64()))

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, digest binary, owner long")


def _told(token: np.ndarray, owner: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by token and owner: where a token's rows begin, and whether it has several owners (by row)."""
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[begin, len(token)])
    several = owner[begin] != owner[begin + size - 1]
    return begin, np.repeat(several | (np.maximum.reduceat(known, begin) == 1), size)


def _survivors(docs: DataFrame, key: str, text: str, classes: DataFrame, bounds: Bounds) -> DataFrame:
    """(cid, doc, digest) of the classes that pass the screen."""

    def emit(batches: _Batches) -> _Batches:
        """Rows (token, owner, state): 0 for an open one, 1 where this batch has told; else (owner, owner, -count told)."""
        memo = near_dups._Memo()
        for whole in batches:
            parts: dict[int, np.ndarray] = {}
            for batch in pieces(whole, 1):
                for t in batch.column(1).to_pylist():
                    s = shingles(t, memo)
                    if len(s):
                        parts[_short(xxhash.xxh3_128_digest(s.tobytes()))] = s[: bounds.screened(len(s))[0]].copy()
            if parts:
                size = [len(s) for s in parts.values()]
                token, owner = np.concatenate(list(parts.values())).view(np.int64), np.repeat(np.fromiter(parts, np.int64, len(parts)), size)
                order = np.lexsort((owner, token))
                token, owner = token[order], owner[order]
                begin, several = _told(token, owner, np.zeros(len(token), np.int64))
                who, count = np.unique(owner[several], return_counts=True)
                stay = ~several
                stay[begin] = True
                yield _batch(token=np.r_[token[stay], who], owner=np.r_[owner[stay], who], state=np.r_[several[stay].astype(np.int64), -count])

    def meet(batches: _Batches) -> _Batches:
        """Sums (owner, told) of sorted rows; a token's rows may go on in the next batch, so its last row is held."""
        held = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            if batch.num_rows:
                token, owner, state = (np.r_[h, c.to_numpy()] for h, c in zip(held, batch.columns, strict=True))
                sums = state < 0
                who, count = [owner[sums]], [-state[sums]]
                token, owner, state = token[~sums], owner[~sums], state[~sums]
                if len(token):
                    begin, several = _told(token, owner, state)
                    new = several & (state == 0)
                    who.append(owner[new])
                    count.append(np.ones(new.sum(), np.int64))
                    last = slice(begin[-1], None)
                    if several[-1]:  # the held row has been told; it tells those to come
                        held = (token[-1:], owner[-1:], np.ones(1, np.int64))
                    else:  # rows of one owner
                        held = (token[last], owner[last], state[last])
                owners, at = np.unique(np.concatenate(who), return_inverse=True)
                yield _batch(owner=owners, told=np.bincount(at, np.concatenate(count), len(owners)).astype(np.int64))

    rows = docs.select(F.col(key).cast("long").alias("doc"), text).where(F.col("doc").isNotNull()).mapInArrow(emit, "token long, owner long, state long")
    told = rows.repartition("token").sortWithinPartitions("token", "owner").mapInArrow(meet, "owner long, told long").groupBy("owner").agg(F.sum("told").alias("told"))
    partner = lambda n: F.ceil(n * bounds.num / bounds.den - 1e-9)
    p = partner(F.col("n"))
    need = F.greatest(F.lit(1), F.least(F.ceil(p / 10 - 1e-9), partner(p)))
    return cut_lineage(classes.join(told, "owner").where(F.col("told") >= need).select("cid", "doc", "digest"))


@lru_cache(maxsize=256)
def _left_out(n: int, many: int) -> np.ndarray:
    """Places of every choice of `many` out of n tokens, one row each."""
    return np.array(list(combinations(range(n), many)), np.int64).reshape(comb(n, many), many)


def subsets(tokens: np.ndarray, size: int) -> np.ndarray:
    """Two 64-bit sums over the tokens of each subset of `size` tokens, whatever their order."""
    n = len(tokens)
    h = np.stack([near_dups._mixed(tokens ^ np.uint64(0x9E3779B97F4A7C15)), near_dups._mixed(tokens + np.uint64(0x632BE59BD9B4E019))], 1)
    return h.sum(0) - h[_left_out(n, n - size)].sum(1)


def _small_links(sets: DataFrame, boundary: int, bounds: Bounds) -> DataFrame:
    """Links (a, b) between sets of at most `boundary` tokens, as stars around each subset's smallest holder."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, who, size, room = [], [], [], []
                for c, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = np.frombuffer(s, np.uint64)
                    for k in bounds.subset_sizes(len(s)):
                        found = subsets(s, k)
                        keys += [k.to_bytes(2, "little") + x.tobytes() for x in found]
                        who += [c] * len(found)
                        size += [len(s)] * len(found)
                        room += [bounds.room(k)] * len(found)
                yield _batch(subset=pa.array(keys, pa.binary()), cid=pa.array(who, pa.int64()), size=pa.array(size, pa.int64()), room=pa.array(room, pa.int64()))

    rows = sets.where(F.col("n") <= boundary).select("cid", "set").mapInArrow(run, "subset binary, cid long, size long, room long")
    hubs = rows.groupBy("subset").agg(F.min(F.struct("size", "cid")).alias("hub"), F.count("*").alias("many")).where("many > 1")
    held = join_hot(rows, written(hubs, "hubs"), "subset", "many", "cid", "inner")
    return held.where((F.col("cid") != F.col("hub.cid")) & (F.col("size") + F.col("hub.size") <= F.col("room"))).select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct()


def _ranked(s: np.ndarray, known: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a set, rare ones first, with their frequencies (0: below those counted)."""
    weight = np.zeros(len(s), np.int64)
    if len(known):
        at = np.searchsorted(known, s).clip(0, len(known) - 1)
        weight = np.where(known[at] == s, count[at], 0)
    order = np.lexsort((s, weight))
    return s[order], weight[order]


def _boundary(sets: DataFrame, common, bounds: Bounds) -> int:
    """The size up to which listing subsets, with scanning lists beyond, costs least rows."""

    def run(batches: _Batches) -> _Batches:
        many, cost = np.zeros(MOST_SMALL + 1, np.int64), np.zeros(MOST_SMALL + 1, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                s = np.frombuffer(s, np.uint64)
                many[len(s)] += 1
                cost[len(s)] += (1 + _ranked(s, *common.value)[1][: len(s) - bounds.partner(len(s)) + 1]).sum()
        yield _batch(n=np.arange(len(many)), many=many, cost=cost)

    found = sets.where(F.col("n") <= MOST_SMALL).select("set").mapInArrow(run, "n long, many long, cost long").groupBy("n").agg(F.sum("many").alias("many"), F.sum("cost").alias("cost")).collect()
    listed, scanned = [0] * (MOST_SMALL + 1), [0] * (MOST_SMALL + 1)
    for r in found:  # one row a size
        listed[r["n"]] = r["many"] * sum(comb(r["n"], k) for k in bounds.subset_sizes(r["n"])) if r["n"] else 0
        scanned[r["n"]] = r["cost"]
    return min(range(MOST_SMALL + 1), key=lambda x: (sum(listed[: x + 1]) + sum(scanned[x + 1 :]), x))


def _lists(sets: DataFrame, common, boundary: int, bounds: Bounds) -> DataFrame:
    """Inverted lists (token, cid, size, place, many, salts) of the prefixes of large sets, and of small ones that large ones can meet."""

    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            cid, size, place, token = [], [], [], []
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                keep = len(s) - bounds.partner(len(s)) + 1
                ranked, _ = _ranked(s, *common.value)
                cid.append(np.full(keep, c))
                size.append(np.full(keep, len(s)))
                place.append(np.arange(keep))
                token.append(ranked[:keep].view(np.int64))
            if cid:
                yield _batch(token=np.concatenate(token), cid=np.concatenate(cid), size=np.concatenate(size), place=np.concatenate(place))

    meets = sets.where(F.col("n") >= bounds.partner(boundary + 1))
    rows = written(meets.select("cid", "set").mapInArrow(run, "token long, cid long, size long, place long"), "prefixes")
    shared = rows.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    return written(join_hot(rows, written(shared, "shared"), "token", "many", "cid", "inner").withColumn("salts", 1 + F.floor(F.col("many") / SPLIT)), "lists")


def _apart(boundary: int, bounds: Bounds):
    """Whether rows _a and _b of one list are of different components, in order of size, and can still link."""
    size_a, size_b = F.col("size_a"), F.col("size_b")
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("cid_a") < F.col("cid_b")))
    shared = F.ceil((size_a + size_b) * bounds.num / (bounds.num + bounds.den) - 1e-9)
    left = F.least(size_a - F.col("place_a"), size_b - F.col("place_b"))
    return ordered & (size_b > boundary) & (F.col("label_a") != F.col("label_b")) & (size_a * bounds.den >= size_b * bounds.num) & (left >= shared)


def _side(rows: DataFrame, side: str, salt) -> DataFrame:
    return rows.select("token", salt, *[F.col(c).alias(f"{c}_{side}") for c in ("cid", "size", "place", "label")])


def _large_links(sets: DataFrame, common, links: DataFrame, boundary: int, bounds: Bounds) -> DataFrame:
    """links, and those of pairs with a large set; pairs that are connected already are left out."""
    lists = _lists(sets, common, boundary, bounds)
    mass = cut_lineage(lists.groupBy("cid").agg(F.sum("many").alias("mass")))
    lists = lists.drop("many")
    salt, every = F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    ends = ("a", "b")
    for pivots in range(1, ROUNDS + 2):
        found = near_dups.components(links)
        labels = cut_lineage(mass.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
        # what a list's members have in common goes to each of its salts, so no task gets a long list whole
        active = lists.join(labels, "cid")
        several = active.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi").select("token", every)
        active = written(active.withColumn("salt", salt.cast("long")).join(several, ["token", "salt"]), "active")
        if active.isEmpty():
            break
        if pivots <= ROUNDS:
            place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("mass"), "cid"))
            chosen = written(active.withColumn("nth", place).where(F.col("nth") <= pivots).drop("nth", "salt"), "pivots")
            sides = [(_side(chosen, p, every), _side(active, q, F.col("salt"))) for p, q in (ends, ends[::-1])]
            pairs = [p.join(q, ["token", "salt"]).where(_apart(boundary, bounds)).select("cid_a", "cid_b") for p, q in sides]
            pairs = pairs[0].unionByName(pairs[1])
            lists = active.drop("salt", "label", "mass").join(chosen.select("token", "cid"), ["token", "cid"], "left_anti")
        else:
            pairs = _side(active, "a", F.col("salt")).join(_side(active, "b", every), ["token", "salt"]).where(_apart(boundary, bounds))
        pairs = cut_lineage(pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct())
        links = cut_lineage(links.unionByName(near_dups._verified(pairs, sets.select("cid", "set"), (bounds.num, bounds.den))))
    return links


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least id reachable by links)."""
    bounds = Bounds(threshold)
    heads = written(_heads(docs, key, text), "heads")
    classes = heads.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("owner").alias("owner"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    sets = near_dups._sets(_survivors(docs, key, text, classes, bounds), docs, key, text)
    sets = written(sets.withColumn("n", (F.octet_length("set") / 8).cast("long")), "sets")
    common = docs.sparkSession.sparkContext.broadcast(near_dups._common(sets))
    boundary = _boundary(sets, common, bounds)
    links = _large_links(sets, common, cut_lineage(_small_links(sets, boundary, bounds)), boundary, bounds)
    return near_dups._result(heads, classes, near_dups.components(links), key).drop("kept")
