"""Running streams: sessions, sinks and idempotent micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import apply_changes, last_change
from ..session import STATE_STORE
from ..sinks.storage import children, exists, open_store, put


# Settings a new session of the application would not take over from the caller's.
INHERITED = ["spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"]


def stream_session(
    spark: SparkSession, state_partitions: int | None = None, *, timers: bool = True
) -> SparkSession:
    """A session of the same application with state in RocksDB.

    The number of state partitions of a query is fixed by its first batch; choose it for the size of the
    state, not of a batch. Queries with processing-time state run batches without data for ever, to fire
    timers; with ``timers=False`` they do not, and so end under ``availableNow``.
    """
    session = spark.newSession()
    for key in INHERITED:
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(timers).lower())
    for key, value in STATE_STORE.items():
        session.conf.set(key, value)
    if state_partitions:
        session.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    return session


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", format: str = "parquet", **options
) -> DataFrame:
    """Runs a stream over all input there is now, into files at ``path``."""
    query = (stream.writeStream.outputMode(mode).format(format).options(**options)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).format(format).load(path)


def run_until(
    stream: DataFrame, path: str, checkpoint: str, rows: int, *, timeout: float = 120.0, poll: float = 0.5
) -> DataFrame:
    """Runs a stream with timers until ``path`` holds ``rows`` rows; fails if none is added for ``timeout`` seconds."""
    query = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
             .trigger(processingTime="100 milliseconds").start(path))
    written = stream.sparkSession.read.schema(stream.schema)
    try:
        before, since, found, counted = 0, time.monotonic(), 0, None
        while not query.awaitTermination(poll):
            progress = query.lastProgress
            if progress and progress["batchId"] != counted:  # rows come with batches: no count without a new one
                found, counted = written.parquet(path).count(), progress["batchId"]
            if found >= rows:
                break
            if found > before or query.status["isTriggerActive"]:
                before, since = found, time.monotonic()
            elif time.monotonic() > since + timeout:
                raise TimeoutError(f"{found} of {rows} rows, none added in {timeout} s")
    finally:
        query.stop()
    return written.parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over all input there is now and keeps its last complete result."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = (stream.writeStream.outputMode("complete").foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def for_each_batch_once(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """``foreachBatch`` that skips batches already handled, so that a restart does not repeat one.

    A marker below the checkpoint is written after ``handle`` returns. ``handle`` must itself bear being
    repeated if the driver is lost between its last write and the marker.
    """
    def once(batch: DataFrame, batch_id: int) -> None:
        store, root = open_store(checkpoint)
        marker = f"{root}/handled/{batch_id}"
        if exists(store, marker):
            return
        handle(batch, batch_id)
        put(store, marker, b"")

    return (stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def apply_change_stream(
    changes: DataFrame, base: DataFrame, root: str, keys: list[str], checkpoint: str, *, merge_every: int = 20,
    **trigger
) -> StreamingQuery:
    """Replays a change stream (columns of ``base``, ``op``, ``lsn``) into a replica below ``root``.

    A micro-batch only adds its changes to ``root/log``. Every ``merge_every`` batches the log since the last
    merge is merged into a new ``root/version=<batch id>``: the last change of each key with its LSN, deletions
    too, so that a change that is delivered again, or late, never wins over a newer one. The table itself is not
    rewritten. Repeating a batch overwrites its own folders only. Read the replica by ``read_replica``.
    """
    def replay(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            merged = last_change(_changes_upto(batch.sparkSession, changes, root, batch_id), keys)
            merged.write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return for_each_batch_once(changes, replay, checkpoint, **trigger)


def read_replica(
    spark: SparkSession, base: DataFrame, changes: DataFrame, root: str, keys: list[str], upto: int | None = None
) -> DataFrame:
    """The replica after batch ``upto`` (the last one by default): ``base`` with the last change of each key."""
    found = _changes_upto(spark, changes, root, upto)
    return base if found is None else apply_changes(base, found, keys)


def _changes_upto(spark: SparkSession, changes: DataFrame, root: str, upto: int | None) -> DataFrame | None:
    """Changes of the newest merged version and of the log behind it."""
    store, folder = open_store(root)

    def complete(names: list[str], kind: str, below: str) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in names if name.startswith(f"{kind}=")
                      and exists(store, f"{folder}/{below}{name}/_SUCCESS"))

    batches = complete(children(store, f"{folder}/log"), "batch", "log/")
    if upto is None:
        upto = batches[-1] if batches else -1
    versions = [number for number in complete(children(store, folder), "version", "") if number < upto + 1]
    version = versions[-1] if versions else -1
    paths = [f"{root}/log/batch={number}" for number in batches if version < number <= upto]
    paths += [f"{root}/version={version}"] if versions else []
    return spark.read.schema(changes.schema).parquet(*paths) if paths else None
