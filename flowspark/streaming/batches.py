"""State that micro-batches leave for the next one, as files below the folder of a stream.

``positions/N.json`` holds a few numbers, ``<kind>/batch=N`` tables of rows. A batch reads what the newest batch before it left,
writes folders of its own and its position last. So a batch that is repeated, whole or after a loss, replaces its own folders.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..sinks.storage import children, get, open_store, put


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def last_position(root: str, before: int) -> tuple[dict, int | None]:
    """What the newest batch before ``before`` left, and its number; nothing and None at the start."""
    store, folder = open_store(root)
    done = [int(name.split(".")[0]) for name in children(store, f"{folder}/positions") if name.endswith(".json")
            and not name.startswith(".")]
    last = max((number for number in done if number < before), default=None)
    return ({}, None) if last is None else (json.loads(get(store, f"{folder}/positions/{last}.json")), last)


def left(spark: SparkSession, root: str, kind: str, last: int | None, schema) -> DataFrame:
    """The rows of a kind that batch ``last`` left."""
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{kind}/batch={last}")


def finish(root: str, number: int, last: int | None, position: dict, kinds: tuple[str, ...]) -> dict:
    """Ends a batch. What batches before the last one left of ``kinds`` goes; the last one's stays, for a repeat of this one."""
    store, folder = open_store(root)
    put(store, f"{folder}/positions/{number}.json", json.dumps(position).encode())
    for kind in kinds:
        for name in children(store, f"{folder}/{kind}"):
            if int(name.split("=")[1]) < (number if last is None else last):
                store.delete_dir(f"{folder}/{kind}/{name}")
    return position


def most(*values):
    """The largest value that is not None."""
    return max((value for value in values if value is not None), default=None)
