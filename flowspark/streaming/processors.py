"""Keyed state machines on ``transformWithStateInPandas``.

A key's rows of one micro-batch are ordered before they are folded into its state, so batches must be
bounded (``maxFilesPerTrigger``, ``maxBytesPerTrigger``), which also bounds what a hot key brings at once.
Order between batches is the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain, islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.retry import MAX_BACKOFF_MS, MAX_SHIFT
from ..operators.ordered import ordered_scan
from ..operators.state import MAX_RETRIES

STATE_TTL_MS = 15 * 60 * 1000
RETRY_QUEUE_TTL_MS = 60 * 60 * 1000
EMITTED_ROWS = 10_000


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _backoff(base_ms: int, attempts: int, cap_ms: int = MAX_BACKOFF_MS) -> int:
    return min(base_ms << min(max(attempts - 1, 0), MAX_SHIFT), cap_ms)


def _widened(rows: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in added.items()]])


class _MessageStates(StatefulProcessor):
    def __init__(self, order: list[str], max_retries: int, ttl_ms: int):
        self.order, self.max_retries, self.ttl_ms = order, max_retries, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getValueState("failures", "n int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures = self.failures.get()[0] if self.failures.exists() else 0
        out = _ordered(rows, self.order)
        outcomes, counts = [], []
        for failed in out["failed"]:
            if failures >= self.max_retries:
                outcomes.append("dead_letter")
            elif failed:
                failures += 1
                outcomes.append("retry")
            else:
                outcomes.append("completed")
            counts.append(failures)
        self.failures.update((failures,))
        yield out.assign(outcome=outcomes, retry_count=counts)

    def close(self) -> None:
        pass


def track_messages(
    arrivals: DataFrame, *, key: str = "message_id", order: list[str], max_retries: int = MAX_RETRIES,
    ttl_ms: int = STATE_TTL_MS,
) -> DataFrame:
    """Retry state per message over a stream (key, order columns, ``failed``).

    Adds ``outcome`` (completed, retry, dead_letter) and ``retry_count``. A message not seen for ``ttl_ms``
    is forgotten.
    """
    rows = arrivals.select(key, *order, "failed")
    schema = _widened(rows, outcome=T.StringType(), retry_count=T.IntegerType())
    return rows.groupBy(key).transformWithStateInPandas(
        _MessageStates(order, max_retries, ttl_ms), schema, "Append", "ProcessingTime")


class _FileStates(StatefulProcessor):
    def __init__(self, order: list[str], max_retries: int, base_ms: int):
        self.order, self.max_retries, self.base_ms = order, max_retries, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processed = handle.getValueState("processed", "head_sha256 string, mtime_s bigint")
        self.failed = handle.getValueState("failed", "attempts int, last_attempt_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.processed.get()) if self.processed.exists() else None
        attempts, tried_at = tuple(self.failed.get()) if self.failed.exists() else (0, 0)
        out = _ordered(rows, self.order)
        actions, counts = [], []
        for sha, mtime, failed, seen_at in zip(out["head_sha256"], out["mtime_s"], out["failed"], out["seen_ms"]):
            if last == (sha, mtime):
                action = "skip"
            elif attempts >= self.max_retries:
                action = "gave_up"
            elif attempts and seen_at - tried_at < _backoff(self.base_ms, attempts):
                action = "wait"
            elif failed:
                attempts, tried_at = attempts + 1, int(seen_at)
                action = "error" if attempts >= self.max_retries else "retry"
            else:
                last, attempts = (sha, int(mtime)), 0
                action = "process"
            actions.append(action)
            counts.append(attempts)
        if last is not None:
            self.processed.update(last)
        if attempts:
            self.failed.update((attempts, tried_at))
        elif self.failed.exists():
            self.failed.clear()
        yield out.assign(action=actions, attempts=counts)

    def close(self) -> None:
        pass


def track_files(
    arrivals: DataFrame, *, key: str = "name", order: list[str], max_retries: int = MAX_RETRIES, base_ms: int = 1000
) -> DataFrame:
    """What to do with each sighting of a file: process, skip, wait, retry, error or gave_up.

    Input is (key, order columns, ``head_sha256``, ``mtime_s``, ``failed``, ``seen_ms``). A version equal to
    the last processed one is skipped; a failed file waits for its backoff, and is given up after
    ``max_retries`` failures.
    """
    names = list(dict.fromkeys([key, *order, "head_sha256", "mtime_s", "failed", "seen_ms"]))
    rows = arrivals.select(*names)
    schema = _widened(rows, action=T.StringType(), attempts=T.IntegerType())
    return rows.groupBy(key).transformWithStateInPandas(
        _FileStates(order, max_retries, base_ms), schema, "Append", "None")


class _Locks(StatefulProcessor):
    def __init__(self, ttl_us: int, order: list[str]):
        self.ttl_us, self.order = ttl_us, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened = self.opened.get()[0] if self.opened.exists() else None
        kept = []
        batch = _ordered(rows, ["at_us", *self.order])
        for at in batch["at_us"]:
            opens = opened is None or at - opened >= self.ttl_us
            if opens:
                opened = int(at)
            kept.append(opens)
        self.opened.update((opened,))
        yield batch[pd.Series(kept, index=batch.index)]

    def close(self) -> None:
        pass


def dedupe_message_stream(
    arrivals: DataFrame, *, key: str = "id", time: str = "ts", ttl_seconds: int = 300, order: list[str] | None = None,
) -> DataFrame:
    """Arrivals that open a lock of ``ttl_seconds`` on their key, whole; duplicates inside it are dropped.

    Of arrivals of one key at one time in a batch the first by ``order`` opens it. The time comes back as a timestamp.
    """
    rows = arrivals.withColumn("at_us", F.unix_micros(F.col(time).cast("timestamp"))).drop(time)
    opened = rows.groupBy(key).transformWithStateInPandas(
        _Locks(ttl_seconds * 1_000_000, order or []), rows.schema, "Append", "None")
    return opened.withColumn(time, F.timestamp_micros("at_us")).select(*arrivals.columns)


class _RetryTimers(StatefulProcessor):
    def __init__(self, max_retries: int, base_ms: int, ttl_ms: int):
        self.max_retries, self.base_ms, self.ttl_ms = max_retries, base_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "attempts int, due bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts = max(int(chunk["attempts"].max()) for chunk in rows)
        if attempts > self.max_retries:
            self.waiting.clear()
            yield pd.DataFrame({"id": [key[0]], "attempts": [attempts], "action": ["give_up"]})
            return
        due = timerValues.getCurrentProcessingTimeInMs() + _backoff(self.base_ms, attempts)
        self.waiting.update((attempts, due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of an earlier failure may still run; only the latest one's time counts.
        waiting = self.waiting.get()  # every call of the state is a round trip, and there is one a message
        if waiting is not None and expiredTimerInfo.getExpiryTimeInMs() >= waiting[1]:
            self.waiting.clear()
            yield pd.DataFrame({"id": [key[0]], "attempts": [waiting[0]], "action": ["release"]})

    def close(self) -> None:
        pass


def schedule_retries(
    failures: DataFrame, *, max_retries: int = MAX_RETRIES, base_ms: int = 1000, ttl_ms: int = RETRY_QUEUE_TTL_MS
) -> DataFrame:
    """Holds failed messages (id, attempts) for their backoff and releases them: (id, attempts, action).

    ``attempts`` counts failures so far; beyond ``max_retries`` the message is given up.
    """
    rows = failures.select(F.col("id").cast("string").alias("id"), F.col("attempts").cast("int").alias("attempts"))
    return rows.groupBy("id").transformWithStateInPandas(
        _RetryTimers(max_retries, base_ms, ttl_ms), "id string, attempts int, action string", "Append",
        "ProcessingTime")


class _Transactions(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "lsn bigint, row string")

    def _emit(self, key, complete: bool) -> Iterator[pd.DataFrame]:
        for entries in batched(self.held.get(), EMITTED_ROWS):
            lsns, rows = zip(*entries)
            yield pd.DataFrame({"txid": [key[0]] * len(lsns), "lsn": lsns, "row": rows,
                                "complete": [complete] * len(lsns)})
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, committed = not self.held.exists(), False
        chunks = iter(rows)
        begun = list(islice(chunks, 2))
        if first and len(begun) == 1 and begun[0]["is_last"].any():
            # Whole in one piece, with nothing held: it needs no state, whose calls are round trips.
            yield pd.DataFrame({"txid": [key[0]] * len(begun[0]), "lsn": begun[0]["lsn"].astype(int), "row": begun[0]["row"],
                                "complete": True})
            return
        for chunk in chain(begun, chunks):
            committed |= bool(chunk["is_last"].any())
            self.held.appendList(list(zip(chunk["lsn"].astype(int), chunk["row"])))
        if committed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield from self._emit(key, True)
        elif first:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._emit(key, False)

    def close(self) -> None:
        pass


def batch_transactions(changes: DataFrame, *, timeout_ms: int = 5000) -> DataFrame:
    """Holds changes (txid, lsn, row, is_last) until their transaction is complete or times out.

    Emits (txid, lsn, row, complete), all changes of a transaction in one micro-batch. They are passed on
    piece by piece, so a huge transaction is never held in memory; ``ordered_transactions`` numbers them.
    """
    rows = changes.select("txid", "lsn", "row", "is_last")
    return rows.groupBy("txid").transformWithStateInPandas(
        _Transactions(timeout_ms), "txid bigint, lsn bigint, row string, complete boolean", "Append",
        "ProcessingTime")


def ordered_transactions(emitted: DataFrame, slices: int | None = None) -> DataFrame:
    """Adds the ``position`` of each change in its transaction, for a batch of emitted transactions."""
    return ordered_scan(emitted, ["txid"], ["lsn"], rank="position", slices=slices)
