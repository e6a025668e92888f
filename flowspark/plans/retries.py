"""Failed deliveries: a durable table of what is to be sent again, drained by passes until delivered or dead.

The table is a log below ``retry_dir``: the folder ``pass=N`` holds, for every message that pass touched, the message and how
it stands: ``completed``, ``retry`` (with ``due_at``) or ``dead_letter``. The last entry of a message is its state; nothing
is ever changed in place. A pass writes its own folder in one commit and nothing else, so a pass that is run again after a
loss replaces what it left and sends again under the same ``X-Message-ID``. Deliveries run where the rows are; the driver sees
counts only. ``compact`` replaces finished passes by the messages still open, so the table does not grow with its history.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.retry import backoff_policy_ms
from ..operators.changes import last_change
from ..sinks import write_dead_letter
from ..sinks.storage import children, exists, open_store

COMPLETED, RETRY, DEAD = "completed", "retry", "dead_letter"
STATE = ("destination", "failures", "waited_ms", "status", "error", "state", "due_at", "pass")

#: Sends the messages of one destination; returns (id, delivered, status, error) for each.
Deliver = Callable[[DataFrame, str, int], DataFrame]


@dataclass(frozen=True)
class RetryPolicy:
    """How often and how long to wait; the waits follow ``backoff_policy_ms``.

    Every failure is followed by a wait. A message that comes back after ``max_failures`` of them is not sent any more.
    """

    max_failures: int = 3
    initial_ms: int = 1000
    multiplier: float = 2.0
    max_ms: int = 30_000

    def wait_ms(self, failures: Column) -> Column:
        return backoff_policy_ms(failures, initial_ms=self.initial_ms, multiplier=self.multiplier, max_ms=self.max_ms)


def passes(retry_dir: str) -> list[int]:
    """Numbers of the passes that were written to their end."""
    store, root = open_store(retry_dir)
    found = [re.fullmatch(r"pass=(\d+)", name) for name in children(store, root)]
    return sorted(int(match[1]) for match in found if match and exists(store, f"{root}/{match[0]}/_SUCCESS"))


def retry_log(spark: SparkSession, retry_dir: str) -> DataFrame | None:
    done = passes(retry_dir)
    if not done:
        return None
    places = [f"{retry_dir.rstrip('/')}/pass={number}" for number in done]
    return spark.read.schema(spark.read.parquet(places[0]).schema).parquet(*places)


def retry_states(spark: SparkSession, retry_dir: str) -> DataFrame | None:
    """The last entry of each message and destination. A message has one entry a pass, so ``pass`` orders them."""
    log = retry_log(spark, retry_dir)
    return None if log is None else last_change(log, ["id", "destination"], ["pass"])


def settle_deliveries(
    sent: DataFrame, report: DataFrame, retry_dir: str, *, number: int, as_of: Column, policy: RetryPolicy,
) -> DataFrame:
    """Writes pass ``number``: where each message of ``sent`` stands after the deliveries of ``report``.

    ``sent`` has the messages with ``destination``, ``failures`` and ``waited_ms`` so far. A message that the report does not know
    counts as failed. Failures are counted over all passes.
    """
    # A message may have been sent twice in a pass that was repeated: delivered once is delivered.
    told = report.groupBy("id").agg(
        F.max("delivered").alias("__delivered"), F.max_by("status", F.struct("delivered", "status")).alias("status"),
        F.min_by("error", F.struct("delivered", "error")).alias("error"))
    joined = sent.drop("status", "error").join(told, "id", "left")
    delivered = F.coalesce("__delivered", F.lit(False))
    failures = F.col("failures") + F.when(delivered, 0).otherwise(1)
    wait = F.when(delivered, F.lit(0).cast("bigint")).otherwise(policy.wait_ms(failures))
    marked = joined.withColumns({"state": F.when(delivered, COMPLETED).otherwise(RETRY), "__wait": wait,
                                 "failures": failures.cast("int"),
                                 "error": F.when(~delivered, F.coalesce("error", F.lit("no report")))})
    entries = marked.withColumns({
        "due_at": F.when(F.col("state") == RETRY, F.timestamp_add("MILLISECOND", F.col("__wait"), as_of)),
        "waited_ms": F.col("waited_ms") + F.col("__wait"),
        "retry_count": F.col("failures"), "last_error": F.coalesce("error", "last_error")}).drop("__delivered", "__wait")
    return _written(entries, retry_dir, number)


def _written(entries: DataFrame, retry_dir: str, number: int) -> DataFrame:
    names = [name for name in entries.columns if name not in STATE]
    placed = entries.withColumn("pass", F.lit(number).cast("int")).select(*names, *STATE)
    path = f"{retry_dir.rstrip('/')}/pass={number}"
    placed.write.mode("overwrite").parquet(path)
    return entries.sparkSession.read.schema(placed.schema).parquet(path)


def first_deliveries(
    sent: DataFrame, report: DataFrame, retry_dir: str, destination: str, *, as_of: Column, policy: RetryPolicy = RetryPolicy(),
    number: int | None = None,
) -> DataFrame:
    """Enters the deliveries of a flow: what a destination's sink reported of the messages it was given."""
    number = number if number is not None else max(passes(retry_dir), default=-1) + 1
    fresh = sent.withColumns({"destination": F.lit(destination), "failures": F.lit(0), "waited_ms": F.lit(0).cast("bigint")})
    return settle_deliveries(fresh, report, retry_dir, number=number, as_of=as_of, policy=policy)


def retry_pass(
    spark: SparkSession, retry_dir: str, deliver: dict[str, Deliver], *, as_of: Column, policy: RetryPolicy = RetryPolicy(),
) -> int:
    """One pass over the messages due by ``as_of``: those with failures left are sent again, the others are dead letters.
    Returns how many there were. What fails is due later, so the next pass needs a later ``as_of``."""
    states = retry_states(spark, retry_dir)
    if states is None:
        return 0
    due = states.filter((F.col("state") == RETRY) & (F.col("due_at") <= as_of))
    spent, left = F.col("failures") >= policy.max_failures, F.col("failures") < policy.max_failures
    open_ = due.groupBy("destination").agg(F.count_if(spent).alias("spent"), F.count_if(left).alias("left")).collect()
    unknown = sorted({row["destination"] for row in open_ if row["left"]} - set(deliver))  # a row a destination
    if unknown:
        raise ValueError(f"no sink for route: {', '.join(unknown)}")
    number = max(passes(retry_dir)) + 1
    if any(row["spent"] for row in open_):
        _written(due.filter(spent).withColumns({"state": F.lit(DEAD), "due_at": F.lit(None).cast("timestamp")}), retry_dir, number)
        number += 1
    for row in sorted(row for row in open_ if row["left"]):
        sent = due.filter(left & (F.col("destination") == row["destination"]))
        report = deliver[row["destination"]](sent.drop(*STATE), row["destination"], number)
        settle_deliveries(sent, report, retry_dir, number=number, as_of=as_of, policy=policy)
        number += 1
    return sum(row["spent"] + row["left"] for row in open_)


def next_due(spark: SparkSession, retry_dir: str) -> datetime | None:
    """When the next message is due; None when none is open."""
    states = retry_states(spark, retry_dir)
    return None if states is None else states.filter(F.col("state") == RETRY).agg(F.min("due_at")).first()[0]


def drain_retries(
    spark: SparkSession, retry_dir: str, deliver: dict[str, Deliver], *, policy: RetryPolicy = RetryPolicy(),
    wait: Callable[[object], Column], dead_dir: str | None = None,
) -> DataFrame:
    """Passes until no message is open; returns the last state of each, None without any. ``wait(moment)`` returns when that
    moment has come, with the time by then as a column. Dead letters of each pass are added to ``dead_dir``, by day."""
    while (moment := next_due(spark, retry_dir)) is not None:
        first, as_of = max(passes(retry_dir)) + 1, wait(moment)
        if retry_pass(spark, retry_dir, deliver, as_of=as_of, policy=policy) == 0:
            raise RuntimeError("messages are open, but none was due")
        dead = retry_log(spark, retry_dir).filter((F.col("pass") == first) & (F.col("state") == DEAD))
        if dead_dir:
            write_dead_letter(dead.drop(*STATE), dead_dir, dead_at=as_of, reason=F.col("last_error"))
    return retry_states(spark, retry_dir)


def compact(spark: SparkSession, retry_dir: str) -> int:
    """Replaces all passes by one that holds the last entry of the messages still open; returns its number.

    Written under the next number first, then the older folders go: a reader in between sees the same states.
    """
    states, done = retry_states(spark, retry_dir), passes(retry_dir)
    if states is None:
        return -1
    number = done[-1] + 1
    states.filter(F.col("state") == RETRY).withColumn("pass", F.lit(number).cast("int")).write.mode("overwrite").parquet(
        f"{retry_dir.rstrip('/')}/pass={number}")
    store, root = open_store(retry_dir)
    for old in done:
        store.delete_dir(f"{root}/pass={old}")
    return number
