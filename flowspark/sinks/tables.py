"""Partitioned logs and keyed tables."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.changes import BATCH_SIZE, MAX_BATCH_SIZE, merge_rows
from .storage import children, open_store


def write_archive(df: DataFrame, path: str, *, processed_at: Column) -> None:
    """Appends processed records under ``archive_date=YYYY-MM-DD``."""
    (df.withColumn("archive_date", processed_at.cast("date"))
     .write.mode("append").partitionBy("archive_date").parquet(path))


def write_errors(df: DataFrame, path: str, *, failed_at: Column, error: Column) -> None:
    """Appends failed records under ``error_date=YYYY-MM-DD`` with time and reason."""
    (df.withColumns({"failed_at": failed_at, "error": error, "error_date": failed_at.cast("date")})
     .write.mode("append").partitionBy("error_date").parquet(path))


def write_dead_letter(env: DataFrame, path: str, *, dead_at: Column, reason: Column | None = None) -> None:
    """Appends dead letters by day, which retention then drops by whole partitions."""
    marked = env.withColumns({"dead_at": dead_at, "dead_date": dead_at.cast("date")})
    if reason is not None:
        marked = marked.withColumn("last_error", reason)
    marked.write.mode("append").partitionBy("dead_date").parquet(path)


def drop_expired_days(path: str, *, as_of: date, days: int, day: str = "archive_date") -> list[str]:
    """Removes the day folders of a log or of an archive that are older than ``days``; returns their days.

    Only folder names are looked at, of which there is one per day: ``archive_date=YYYY-MM-DD`` as logs have them,
    or ``YYYY-MM-DD`` as ``settle_files`` makes them.
    """
    store, root = open_store(path)
    limit = (as_of - timedelta(days=days)).isoformat()
    days_of = {name: re.fullmatch(rf"(?:{re.escape(day)}=)?(\d{{4}}-\d\d-\d\d)", name) for name in children(store, root)}
    expired = {name: found[1] for name, found in days_of.items() if found and found[1] < limit}
    for name in expired:
        store.delete_dir(f"{root}/{name}")
    return sorted(set(expired.values()))


def jdbc_write_options(url: str, table: str, *, batch_size: int = BATCH_SIZE, **properties) -> dict[str, str]:
    if not 1 <= batch_size <= MAX_BATCH_SIZE:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH_SIZE}")
    return {"url": url, "dbtable": table, "batchsize": str(batch_size), **properties}


def write_table_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", **options) -> None:
    """Inserts rows into a database table, each partition in batches over a connection of its own."""
    df.write.format("jdbc").options(**jdbc_write_options(url, table, **options)).mode(mode).save()


class WriteConflict(Exception):
    """Rows the chosen strategy does not allow."""


def write_table(
    target: DataFrame, incoming: DataFrame, keys: list[str], out_path: str, *, strategy: str = "upsert",
    on_conflict: str = "fail",
) -> DataFrame:
    """Writes ``target`` with ``incoming`` merged to ``out_path``, which must not be where it is read from.

    The caller switches to the new path, so readers see the old table or the new one. With
    ``on_conflict="skip"`` rows the strategy forbids are left out instead of failing the write.
    """
    merged, conflicts = merge_rows(target, incoming, keys, strategy)
    if on_conflict == "fail":
        example = conflicts.select(*keys).first()
        if example is not None:
            raise WriteConflict(f"{strategy}: {example.asDict()}")
    merged.write.mode("overwrite").parquet(out_path)
    return target.sparkSession.read.schema(merged.schema).parquet(out_path)
