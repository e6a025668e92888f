"""Counts by event time over a stream that forgets: windows that close, requests that are numbered as they come.

State is one count for each key and open window, in files beside the stream (see ``batches``). The newest event time of all
batches so far, less ``delay``, is the mark: windows that end by it are closed and leave the state. A row of a window that the
mark before its batch had closed is late: it is written to ``late/batch=N``, whole, and counted nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import ordered_scan
from .batches import finish, last_position, left, most, written
from .runs import for_each_batch_once

COUNTS = "__key string, __start bigint, n bigint"


def _start(time: str, width_us: int) -> Column:
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return us - F.pmod(us, F.lit(width_us))


def _landed(batch: DataFrame, root: str, number: int, by: str, time: str, width_us: int, delay_us: int):
    """The batch's rows that are in time, the mark before it, the newest time with it, and the batch before."""
    state, last = last_position(root, number)
    mark = None if state.get("newest") is None else state["newest"] - delay_us
    # Written first, so that a batch is read once and each part of it from there.
    rows = written(batch.withColumns({"__key": F.col(by).cast("string"), "__start": _start(time, width_us)}),
                   f"{root}/landed/batch={number}")
    newest = most(state.get("newest"), rows.agg(F.max(F.unix_micros(F.col(time).cast("timestamp")))).first()[0])
    if mark is not None:
        closed = F.col("__start") + width_us <= mark
        late = rows.filter(closed).drop("__key", "__start")
        if not late.isEmpty():
            written(late, f"{root}/late/batch={number}")
        rows = rows.filter(~closed)
    return rows, newest, last


def rate_batch(
    batch: DataFrame, root: str, number: int, *, by: str = "tenant_id", time: str = "created_at", width_seconds: int = 300,
    delay_seconds: float = 600, flush: bool = False,
) -> dict:
    """One batch of messages: windows that it closes are written to ``out/batch=N`` as (``by``, window_start, window_end, messages,
    per_second), each once. ``flush`` closes all: the stream has ended."""
    root, width, delay = root.rstrip("/"), width_seconds * 1_000_000, int(delay_seconds * 1_000_000)
    rows, newest, last = _landed(batch, root, number, by, time, width, delay)
    counts = rows.groupBy("__key", "__start").agg(F.count(F.lit(1)).alias("n")).unionByName(
        left(batch.sparkSession, root, "open", last, COUNTS)).groupBy("__key", "__start").agg(F.sum("n").alias("n"))
    counts = written(counts, f"{root}/counts/batch={number}")
    over = F.lit(True) if flush else F.lit(False) if newest is None else F.col("__start") + width <= newest - delay
    closed = counts.filter(over).select(
        F.col("__key").alias(by), F.timestamp_micros("__start").alias("window_start"),
        F.timestamp_micros(F.col("__start") + width).alias("window_end"), F.col("n").alias("messages"),
        (F.col("n") / width_seconds).alias("per_second"))
    written(closed, f"{root}/out/batch={number}")
    written(counts.filter(~over), f"{root}/open/batch={number}")
    return finish(root, number, last, {"newest": newest}, ("open", "counts", "landed"))


def rate_stream(messages: DataFrame, root: str, checkpoint: str, *, by: str = "tenant_id", time: str = "created_at",
                width_seconds: int = 300, delay_seconds: float = 600, **trigger) -> StreamingQuery:
    """Runs ``rate_batch`` for each micro-batch of a stream of messages."""
    return for_each_batch_once(messages, lambda batch, number: rate_batch(
        batch, root, number, by=by, time=time, width_seconds=width_seconds, delay_seconds=delay_seconds) and None, checkpoint, **trigger)


def flag_batch(
    batch: DataFrame, root: str, number: int, *, limit: int = 1000, key: str = "key", time: str = "ts",
    order: list[str] | None = None, delay_seconds: float = 60,
) -> dict:
    """One batch of requests, numbered on within their key and minute and marked beyond the limit, to ``out/batch=N``.

    Requests of one batch are numbered by ``order``; those of a later batch come after them. Each is flagged in its own batch.
    """
    root, minute, delay = root.rstrip("/"), 60_000_000, int(delay_seconds * 1_000_000)
    rows, newest, last = _landed(batch, root, number, key, time, minute, delay)
    known = left(batch.sparkSession, root, "open", last, COUNTS)
    numbered = ordered_scan(rows, ["__key", "__start"], order or [time], rank="__rank")
    carried = numbered.join(known.withColumnRenamed("n", "__n"), ["__key", "__start"], "left").withColumn(
        "request_number", F.col("__rank") + F.coalesce("__n", F.lit(0)))
    flagged = carried.withColumn("over_limit", F.col("request_number") > limit).select(
        *batch.columns, "request_number", "over_limit")
    written(flagged, f"{root}/out/batch={number}")
    counts = rows.groupBy("__key", "__start").agg(F.count(F.lit(1)).alias("n")).unionByName(known).groupBy(
        "__key", "__start").agg(F.sum("n").alias("n"))
    written(counts if newest is None else counts.filter(F.col("__start") + minute > newest - delay), f"{root}/open/batch={number}")
    return finish(root, number, last, {"newest": newest}, ("open", "landed"))


def flag_stream(requests: DataFrame, root: str, checkpoint: str, *, limit: int = 1000, key: str = "key", time: str = "ts",
                order: list[str] | None = None, delay_seconds: float = 60, **trigger) -> StreamingQuery:
    """Runs ``flag_batch`` for each micro-batch of a stream of requests."""
    return for_each_batch_once(requests, lambda batch, number: flag_batch(
        batch, root, number, limit=limit, key=key, time=time, order=order, delay_seconds=delay_seconds) and None, checkpoint, **trigger)


def read_batches(spark: SparkSession, root: str, kind: str = "out") -> DataFrame:
    """What the batches wrote of a kind (``out``, ``late``, ``open``), with the ``batch`` each row is of."""
    return spark.read.parquet(f"{root.rstrip('/')}/{kind}")
