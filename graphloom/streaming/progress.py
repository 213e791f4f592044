"""Progress of analyses as a stream: the latest status per repository, and a listener that ends with it."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from datetime import UTC

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from graphloom.functions import text as fn
from graphloom.session import ship

#: States after which nothing more comes.
TERMINAL = ("completed", "failed")


def latest_status(events: DataFrame, key: str = "repo_id", time: str = "ts", tie: str = "seq") -> DataFrame:
    """The latest event per key, for a batch or a stream (one row of state per key)."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("last")).select(key, "last.*")


class _Latest(StatefulProcessor):
    """Gives out the newest event of a key when it changes, and holds its time (at_), tie and status; a key that has
    ended is forgotten later."""

    def __init__(self, names: list[str], kinds: T.StructType, linger: int):
        self.names, self.kinds, self.linger = names, kinds, linger

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("latest", self.kinds)

    @staticmethod
    def _place(at: int | None, tie) -> tuple:
        return at is not None, at, tie is not None, tie

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tie = self.kinds.names[1]
        held = self.state.get() if self.state.exists() else None
        best = max((r.asDict() for r in rows), key=lambda r: self._place(r["at_"], r[tie]))
        if held is None or self._place(best["at_"], best[tie]) > self._place(held[0], held[1]):
            self.state.update((best["at_"], best[tie], best.get("status")))
            if best.get("status") in TERMINAL and best["at_"] is not None:
                self.handle.registerTimer(best["at_"] // 1000 + self.linger)
            yield Row(**{c: best[c] for c in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        if held is not None and held[2] in TERMINAL:  # not if it has begun anew
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Rows of a task that are looked through for their keys' newest at a time.
PIECE = 100_000


def newest(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Of the events that a task reads of a batch, the newest per key and PIECE rows or more; keys aren't null."""

    def last(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [(key, "ascending"), (time, "ascending"), (tie, "ascending")], null_placement="at_start")
        rows = rows.take(order).combine_chunks()
        keys = rows[key]
        if len(rows) < 2:
            return rows
        ends = pc.not_equal(keys.slice(0, len(keys) - 1), keys.slice(1)).combine_chunks()
        return rows.filter(pa.concat_arrays([ends, pa.array([True])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += len(batch)
            if many >= PIECE:
                rows = last(pa.Table.from_batches(held))
                held, many = rows.to_batches(), len(rows)
                if 2 * many > PIECE:  # too many keys to be worth holding
                    yield from held
                    held, many = [], 0
        if many:
            yield from last(pa.Table.from_batches(held)).to_batches()

    return events.mapInArrow(run, events.schema)


def updates(events: DataFrame, key: str = "repo_id", time: str = "ts", tie: str = "seq", late: str = "10 minutes", linger_ms: int = 600_000) -> DataFrame:
    """A stream of each key's latest status whenever it changes (update mode), with a state per key.

    An event is known by its key, time and tie. Of a batch each task gives its keys' newest events on, as the others change
    nothing. Repeated events are dropped while the watermark, `late` behind the newest event, hasn't passed them; older
    events don't come back. A key whose latest status is terminal leaves the state when the watermark is linger_ms
    beyond it, so the state holds what runs, not all that ever ran. Events without a key are dropped; of events of one
    time the greatest tie counts; without a time they are the oldest. Start it with `start_updates`.
    """
    ship(events.sparkSession)
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need one with a time zone
    fresh = newest(events.where(F.col(key).isNotNull()), key, time, tie).withWatermark(time, late).dropDuplicatesWithinWatermark([key, time, tie])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fresh.schema.fields])
    kinds = T.StructType([T.StructField("at_", T.LongType()), T.StructField(tie, schema[tie].dataType), T.StructField("status", T.StringType())])
    processor = _Latest(schema.names, kinds, linger_ms)
    return fresh.withColumn("at_", F.unix_micros(time)).groupBy(key).transformWithState(processor, schema, "Update", "EventTime")


#: The state store that keyed states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def start_updates(changes: DataFrame, folder: str, checkpoint: str, available_now: bool = False, interval: str = "500 milliseconds") -> StreamingQuery:
    """Appends the changes to a table in the shared folder, each batch once; `latest_status` of it is the present state."""
    spark = changes.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)  # a query keeps what was set when it started
    try:
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def current(spark: SparkSession, folder: str, schema: T.StructType, key: str = "repo_id", time: str = "ts", tie: str = "seq") -> DataFrame:
    """The latest status per key of what start_updates has written."""
    return latest_status(spark.read.schema(schema).parquet(folder).select(*schema.names), key, time, tie)


def follow(events: DataFrame, repo_id: str, push: Callable[[dict], None], interval: str = "500 milliseconds", available_now: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Pushes a repository's latest status whenever it changes; the query ends with a terminal status.

    push gets {"status": "not_found"} if the first batch has nothing of the repository. With a checkpoint folder
    a new start goes on where the last one ended.
    """
    holder: dict[str, object] = {"last": None}
    started, ended = threading.Event(), threading.Event()

    def stop_at_the_end() -> None:
        ended.wait()
        started.wait()  # the first batch may end before start() has returned
        holder["query"].stop()

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.collect()  # one row: the state of one repository
        found = rows[0].asDict() if rows else {"status": "not_found"}
        if found != holder["last"] and (rows or holder["last"] is None):
            holder["last"] = found
            push(found)
        if found["status"] in TERMINAL:
            ended.set()

    writer = latest_status(events.where(F.col("repo_id") == repo_id)).withColumn("progress", fn.progress(F.col("progress"))).writeStream.outputMode("complete").foreachBatch(one)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    if not available_now:
        threading.Thread(target=stop_at_the_end, daemon=True).start()  # a batch can't stop its own query
    holder["query"] = query = writer.start()
    started.set()
    return query


def status(live: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, status, progress): the live state, else that of the latest snapshot, 100 if completed."""
    stored = snapshots.groupBy("repo_id").agg(F.max_by("status", F.struct("analyzed_at", "id")).alias("stored"))
    both = stored.join(live.select("repo_id", F.col("status").alias("live"), "progress"), "repo_id", "full_outer")
    done = F.when(F.col("stored") == "completed", 100.0).otherwise(0.0)
    return both.select("repo_id", F.coalesce("live", "stored").alias("status"), F.when(F.col("live").isNotNull(), F.col("progress")).otherwise(done).alias("progress"))


def may_start(repo_known: bool, running: bool, sha: str | None) -> int:
    """HTTP status of a request to start: 404, 409, 400 or 202."""
    if not repo_known:
        return 404
    if running:
        return 409
    if sha is not None and not (4 <= len(sha) <= 40 and all(c in "0123456789abcdef" for c in sha.lower())):
        return 400
    return 202
