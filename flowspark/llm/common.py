"""What the operators of this folder share: reading tables, cutting lineage, splitting into words."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import estimated_bytes, shared_dir

#: White space that separates words: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stashed(df: DataFrame, purpose: str, options: dict | None = None) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again: a lost executor costs a read.
    ``options`` are those of the writer."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, each: int) -> int:
    """How many parts of some ``each`` bytes ``df`` asks for, and at least the shuffle partitions of the session. A table whose
    size the planner doesn't know (it then counts as endless) gets these."""
    size, least = estimated_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // each)) if size < 1 << 60 else least


def sampled(df: DataFrame, key: Column, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` rows, never more, by the hash of a key: rows are dropped where they are read, so that
    no task gets more than the sample."""
    share = int(min(1.0, most / max(1, total)) * (1 << 30))
    return df.filter(F.pmod(key, F.lit(1 << 30)) < share).orderBy(key).limit(most)


def freed(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back to the machine when its task is over; workers live on.

    Functions come by value, each task with globals of its own that refer to them and they to these: without a collection
    a worker keeps the tables of all its tasks.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
    return task


def words_of(text: Column) -> Column:
    """Words of a text, none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
