"""MinHash near-duplicates with SetSketch registers: mergeable, exponentially spaced truncated minima.

Documents with equal shingle sets form a class; only one row per class goes on. A class has REGISTERS
registers, floor(1 - log_b(min x)) with x ~ Exp(RATE) per shingle, cut off to 16 bits. BANDS bands of
register values give buckets. A bucket never expands into all its pairs: in ROUNDS rounds its members
are compared with one pivot, then two, and only across components that aren't connected yet; a pivot
whose links in a bucket are all tested leaves it. What buckets with several components still hold (copies
edited too much to link with a pivot) meets in an exact prefix join: shingles ordered by their frequency
in these sets, rare ones first, prefixes and positions bounded by the threshold. So every pair of a
bucket is tested, excluded by a bound, or already connected. Candidates get a joint maximum-likelihood
estimate of their similarity from the registers; those that can still reach the threshold are verified
on the full sets.

At the threshold of 0.75 a pair shares no band with probability (1 - 0.75^3)^32 < 3e-8.

Defined results: a text that is null, empty or without words has no set, n_shingles 0 and links with
nothing; rows without an id are returned with component_id null and kept true, and link with nothing;
repeated rows (and repeated ids) each give one row; outputs hold the id column and new columns only, so
extra columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.carry import pieces
from graphloom.llm.hot import join_hot
from graphloom.session import cut_lineage, written

WORDS = 5
THRESHOLD = (75, 100)
BAND_ROWS, BANDS = 3, 32
REGISTERS = BAND_ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: A pair is dropped unverified if its estimate is so far below the threshold: six standard deviations.
MARGIN = 6 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Rows of ids that may be broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Rounds with pivots before the prefix join, and shingles whose frequency orders its prefixes.
ROUNDS, COMMON = 2, 1_000_000
#: Members of a bucket, and holders of a shingle, that meet in one place; larger groups are dealt by salts.
SPLIT = 500
#: Words hashed once per task before the memo starts anew.
MEMO = 100_000
#: Shingles sketched together.
FLAT = 400_000

_RNG = np.random.Generator(np.random.PCG64(20240917))
_MULTIPLIERS = _RNG.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, REGISTERS, np.uint64)
_PLACES = _RNG.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value



def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased in A-Z."""
    return (text or "").encode().lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def shingles(text: str | None, memo: _Memo) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    ws = words(text)
    if len(ws) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), len(ws))] if ws else [], np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - WORDS + 1
    return np.unique(_mixed(sum(h[k : k + n] * _PLACES[k] for k in range(WORDS))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (one row per set, none empty)."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    low = np.stack([np.minimum.reduceat((flat ^ s) * a, start) for a, s in zip(_MULTIPLIERS, _SHIFTS, strict=True)], 1)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = rows.astype(np.uint64).reshape(len(rows), BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_ROWS):
        key = _mixed(key ^ parts[:, :, k]) + np.uint64(k + 1)
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of register rows, given the set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 129)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * grid), p(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum(np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(q, 1e-300)), 0) for n, q in ((above, more), (below, less), (same, 1 - more - less)))
    return grid[np.arange(len(a)), score.argmax(1)]


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, n, digest (16 bytes, null without words) and registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                sets, total, begin = [], 0, at
                while at < len(texts) and total < FLAT:
                    sets.append(shingles(texts[at], memo))
                    total += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                rows = iter(registers(full) if full else ())
                sketch = [next(rows).tobytes() if len(s) else None for s in sets]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, at - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc", "n", "digest", "sketch"])

    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType())])
    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """(key, cid) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(rows).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "cid"])

    return classes.select("cid", "sketch").mapInArrow(run, "key long, cid long")


def _dealt(pairs: DataFrame) -> DataFrame | None:
    """(cid, salts) of the classes in so many of the pairs (a, b) that they meet dealt by salts; None if there are none.

    There is at most one for SPLIT / 2 pairs, so where they are few they are broadcast and the pairs aren't shuffled for them.
    """
    many = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg((1 + F.floor(F.count("*") / SPLIT)).alias("salts"))
    many = written(many.where("salts > 1"), "salts")
    n = many.count()
    return (F.broadcast(many) if n <= BROADCAST_IDS else many) if n else None


def _attached(rows: DataFrame, dealt: DataFrame | None, classes: DataFrame, side: str, other: str, columns: dict[str, str]) -> DataFrame:
    """rows of pairs (a, b) with columns of one side's class. A pivot may be in very many pairs: they are dealt by salts."""
    held = classes.select(F.col("cid").alias(side), *[F.col(c).alias(name) for c, name in columns.items()])
    if dealt is None:
        return rows.join(held, side)
    salts = dealt.withColumnRenamed("cid", side)
    held = held.join(salts, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    rows = rows.join(salts, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
    return rows.join(held, [side, "salt"]).drop("salt")


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose joint estimate can still reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
                near = estimate(a, b, part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float))
                yield part.filter(pa.array(near >= threshold - MARGIN)).select(["a", "b"])

    # the larger set bounds the similarity: sizes below the threshold's ratio can't link
    dealt = _dealt(pairs)
    sized = _attached(_attached(pairs, dealt, classes, "a", "b", {"n": "n_a", "sketch": "s_a"}), dealt, classes, "b", "a", {"n": "n_b", "sketch": "s_b"}).where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(cid, set) of the classes in ids (cid, doc, digest), made anew from their texts."""
    few = ids.count() <= BROADCAST_IDS
    picked = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).join(F.broadcast(ids) if few else ids, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            for part in pieces(batch, 1):
                found = [shingles(t, memo).tobytes() for t in part.column(1).to_pylist()]
                same = [xxhash.xxh3_128_digest(s) == d for s, d in zip(found, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["cid", "set"]).filter(pa.array(same))

    full = picked.select("cid", "t", "digest").mapInArrow(run, "cid long, set binary")
    return full.groupBy("cid").agg(F.first("set").alias("set"))  # an id may be repeated with the same text


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs that link, compared on full sets."""
    num, den = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    dealt = _dealt(pairs)
    joined = _attached(_attached(pairs, dealt, sets, "a", "b", {"set": "x"}), dealt, sets, "b", "a", {"set": "y"})
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of the sets with their counts, at most COMMON of them, by shingle.

    They only order the prefixes: any order gives whole results, so the bound loses nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                flat = np.frombuffer(b"".join(batch.column(0).slice(at, 500).to_pylist()), np.int64)
                token, count = np.unique(flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], names=["token", "count"])

    counts = sets.select("set").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    found = counts.where(F.col("count") >= 4).orderBy(F.desc("count"), "token").limit(COMMON).toPandas()
    order = np.argsort(found["token"].to_numpy().astype(np.uint64))
    return found["token"].to_numpy().astype(np.uint64)[order], found["count"].to_numpy().astype(np.int64)[order]


def _prefix_pairs(sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that pass the prefix, size and position bounds.

    a is the smaller set: the sets of a pair share 2t / (1 + t) of it at least, so its prefix is the shorter one.
    Holders of a frequent shingle are dealt by salts.
    """
    common = sets.sparkSession.sparkContext.broadcast(_common(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common.value
        for batch in batches:
            cid, size, place, token, salts = [], [], [], [], []
            for c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                n = len(s)
                weight = np.zeros(n, np.int64)
                if len(known):
                    at = np.searchsorted(known, s).clip(0, len(known) - 1)
                    weight = np.where(known[at] == s, count[at], 0)
                first = np.lexsort((s, weight))[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
                prefix = s[first]
                cid.append(np.full(len(prefix), c))
                size.append(np.full(len(prefix), n))
                place.append(np.arange(len(prefix)))
                token.append(prefix.astype(np.int64))
                salts.append(1 + weight[first] // SPLIT)
            if cid:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, cid, size, place, salts)], names=["token", "cid", "size", "place", "salts"])

    rows = written(sets.select("cid", "set").mapInArrow(run, "token long, cid long, size long, place long, salts long").join(labels, "cid"), "prefixes")
    short = F.col("place") <= F.col("size") - F.ceil(2 * threshold / (1 + threshold) * F.col("size") - 1e-9)
    salt = F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt")
    a = rows.where(short).select("token", salt, *[F.col(c).alias(f"{c}_a") for c in ("cid", "size", "place", "label")])
    b = rows.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("cid", "size", "place", "label")])
    shared = F.ceil(threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - 1e-9)
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("cid_a") < F.col("cid_b")))
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    bound = smaller & (F.col("label_a") != F.col("label_b")) & (F.col("size_a") >= threshold * F.col("size_b") - 1e-9) & (left >= shared)
    pairs = a.join(b, (a["token"] == b["token"]) & (a["salt"] == b["salt"]) & bound)
    return pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node reachable.

    Minimum labels spread along links, then labels jump to their label's label; lineage is cut each round.
    """
    both = cut_lineage(links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")))
    while True:
        spread = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("around"))
        after = labels.join(spread, "node").select("node", F.least("label", "around").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        after = cut_lineage(after.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), "was"))
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row per document: key, n_shingles, component_id (least id reachable), kept."""
    least = threshold[0] / threshold[1]
    sketches = written(_sketches(docs, key, text), "sketches")
    classes = sketches.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    bands = _bands(classes)
    crowded = written(bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "buckets")
    members = join_hot(bands, crowded, "key", "many", "cid", "inner").withColumn("salts", 1 + F.floor(F.col("many") / SPLIT))
    members = written(members, "members")
    mass = cut_lineage(members.groupBy("cid").agg(F.sum("many").alias("mass")))
    state = mass.withColumn("label", F.col("cid"))
    links, found = None, None
    salt, every = F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    for pivots in range(1, ROUNDS + 2):
        # what a bucket's members have in common goes to each of its salts, so no task gets a large bucket whole
        active = members.join(state, "cid").select("key", salt, "cid", "label", "mass", "salts")
        open_ = active.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi").select("key", every)
        active = written(active.join(open_, ["key", "salt"]), "active")
        if active.isEmpty():
            break
        if pivots <= ROUNDS:
            # the most central members go first: they share more buckets with the others
            place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("mass"), "cid"))
            chosen = written(active.withColumn("place", place).where(F.col("place") <= pivots).select("key", "cid", "label", "salts"), "pivots")
            pairs = chosen.select("key", every, F.col("cid").alias("p"), F.col("label").alias("p_label")).join(active, ["key", "salt"]).where("p <> cid and p_label <> label")
            pairs = cut_lineage(pairs.select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).distinct())
            members = active.select("key", "cid", "salts").join(chosen.select("key", "cid"), ["key", "cid"], "left_anti")
            near = cut_lineage(_plausible(pairs, classes, least))
            sets = _sets(_ids(near.select(F.explode(F.array("a", "b")).alias("cid")), classes), docs, key, text)
        else:
            sets = written(_sets(_ids(active.select("cid"), classes), docs, key, text), "sets")
            near = cut_lineage(_plausible(cut_lineage(_prefix_pairs(sets, state.select("cid", "label"), least)), classes, least))
        new = _verified(near, sets, threshold)
        links = cut_lineage(new if links is None else links.unionByName(new))
        found = components(links)
        state = cut_lineage(mass.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")))
    return _result(sketches, classes, found, key)


def _ids(cids: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, doc, digest) of the distinct classes in a column of cids."""
    return cut_lineage(cids.distinct().join(classes.select("cid", "doc", "digest"), "cid"))


def _result(sketches: DataFrame, classes: DataFrame, found: DataFrame | None, key: str) -> DataFrame:
    """Component ids of all rows; only classes with copies or links are joined."""
    grouped = classes.where("copies > 1").select("digest", F.col("doc").alias("component"), "copies")
    if found is not None:
        linked = classes.join(found.withColumnRenamed("node", "cid"), "cid")
        least = linked.groupBy("label").agg(F.min("doc").alias("component"))
        linked = linked.join(least, "label").select("digest", "component", "copies", "cid")
        alone = classes.where("copies > 1").join(linked.select("cid"), "cid", "left_anti").select("digest", F.col("doc").alias("component"), "copies")
        grouped = linked.select("digest", "component", "copies").unionByName(alone)
    out = join_hot(sketches.select("doc", "n", "digest"), written(grouped, "components"), "digest", "copies", "doc")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"))
