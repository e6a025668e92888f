"""Changes of a feed in LSN order: held until nothing before them can come any more, then given out in order.

A micro-batch is joined with the changes held so far, and what precedes every open transaction and lies far enough back in
event time is written to ``out/batch=N``, sorted by LSN over its files; the rest is held in ``held/batch=N``. So LSNs rise from row to row,
file to file and batch to batch, interleaved transactions included. All steps are Spark jobs over the held changes; the driver
sees the position only. What is held is as large as the open transactions and ``hold_seconds`` of the feed.

- A transaction is open from its first change until the one with ``is_last`` has come, or until ``open_seconds`` of event time
  have passed since its first change; then it goes out with ``complete`` false.
- A change may come up to ``hold_seconds`` of event time late. One that comes later still, or again after it was given out,
  is written to ``late/batch=N`` with its LSN below the position, and not among the others.
- A change that comes again while it is held counts once. A batch that is repeated replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .batches import finish, last_position, most, written
from .runs import for_each_batch_once

def order_batch(
    batch: DataFrame, root: str, number: int, *, hold_seconds: float, open_seconds: float, flush: bool = False,
) -> dict:
    """One batch of changes (txid, lsn, ts, is_last and any other columns); returns the position after it.

    With ``flush`` everything held goes out: the feed has ended.
    """
    spark, root = batch.sparkSession, root.rstrip("/")
    state, last = last_position(root, number)
    position = state.get("position")
    fresh = batch.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    # Written first: the batch is read once, and a batch without late changes leaves no folder.
    landed = written(fresh, f"{root}/landed/batch={number}")
    if position is not None:
        late = landed.filter(F.col("lsn") <= position).drop("__us")
        if not late.isEmpty():
            written(late, f"{root}/late/batch={number}")
        landed = landed.filter(F.col("lsn") > position)
    if last is not None:
        landed = spark.read.schema(landed.schema).parquet(f"{root}/held/batch={last}").unionByName(landed)
    held = landed.dropDuplicates(["lsn"])

    by_tx = held.groupBy("txid").agg(F.min("lsn").alias("first"), F.min("__us").alias("began"), F.max("__us").alias("newest"),
                                     F.bool_or("is_last").alias("done"))
    seen = most(state.get("newest"), by_tx.agg(F.max("newest")).first()[0])
    limit = None
    if not flush and seen is not None:
        waiting = by_tx.filter(~F.col("done") & (F.col("began") > seen - int(open_seconds * 1e6))).agg(F.min("first")).first()[0]
        recent = held.filter(F.col("__us") > seen - int(hold_seconds * 1e6)).agg(F.min("lsn")).first()[0]
        limit = min((lsn for lsn in (waiting, recent) if lsn is not None), default=None)
    out = held if limit is None else held.filter(F.col("lsn") < limit)
    given = out.join(by_tx.select("txid", F.col("done").alias("complete")), "txid").drop("__us")
    ordered = written(given.repartitionByRange("lsn").sortWithinPartitions("lsn"), f"{root}/out/batch={number}")
    written(held.limit(0) if limit is None else held.filter(F.col("lsn") >= limit), f"{root}/held/batch={number}")
    now = {"position": most(position, ordered.agg(F.max("lsn")).first()[0]), "newest": seen}
    return finish(root, number, last, now, ("held", "landed"))


def order_stream(
    changes: DataFrame, root: str, checkpoint: str, *, hold_seconds: float = 5.0, open_seconds: float = 60.0, **trigger,
) -> StreamingQuery:
    """Runs ``order_batch`` for each micro-batch of a stream of changes."""
    def handle(batch: DataFrame, number: int) -> None:
        order_batch(batch, root, number, hold_seconds=hold_seconds, open_seconds=open_seconds)

    return for_each_batch_once(changes, handle, checkpoint, **trigger)


def flush_order(spark: SparkSession, root: str, *, batch: int) -> dict:
    """Gives out what is still held, as batch ``batch``, when the feed has ended."""
    _, last = last_position(root, batch)
    if last is None:
        return {}
    held = spark.read.parquet(f"{root.rstrip('/')}/held/batch={last}")
    return order_batch(held.drop("__us").limit(0), root, batch, hold_seconds=0, open_seconds=0, flush=True)


def read_ordered(spark: SparkSession, root: str) -> DataFrame:
    """Everything given out, with the ``batch`` it left in."""
    return spark.read.parquet(f"{root.rstrip('/')}/out")
