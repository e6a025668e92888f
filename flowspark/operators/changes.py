"""Change records: images, transactions, batches, replay and conflict handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import ordered_scan

BATCH_SIZE = 100
MAX_BATCH_SIZE = 1000


def last_change(changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last change of each key. The position filter is also applied before the shuffle, so a hot key
    sends one row per task."""
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(column) for column in order or ["lsn"]])
    return (changes.withColumn("__position", F.row_number().over(newest_first))
            .filter(F.col("__position") == 1).drop("__position"))


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], *, op: str = "op") -> DataFrame:
    """State of ``target`` after replaying ``changes`` in LSN order.

    ``changes`` carries the columns of ``target`` with their new values. The target is read and joined
    once; it is not shuffled when the changed keys are few enough to be broadcast.
    """
    latest = last_change(changes, keys)
    untouched = target.join(latest.select(*keys), keys, "left_anti").select(*target.columns)
    return untouched.unionByName(latest.filter(F.col(op) != "D").select(*target.columns))


def merge_rows(
    target: DataFrame, incoming: DataFrame, keys: list[str], strategy: str = "upsert"
) -> tuple[DataFrame, DataFrame]:
    """``(merged, conflicts)`` of writing ``incoming``.

    ``insert`` conflicts with rows that exist, ``update`` with rows that do not. Rows of ``incoming`` that share
    their keys, or have a NULL among them, conflict under every strategy: none of them is written.
    """
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    given = incoming.select(*target.columns)
    # Counted before any row is shuffled; rows without a whole key go past, since they would all meet in one task.
    repeated = given.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("__same")).filter("__same > 1").select(*keys)
    rows = given.filter(whole).join(repeated, keys, "left_anti").select(*target.columns)
    unclear = given.filter(~whole).unionByName(given.filter(whole).join(repeated, keys, "left_semi").select(*target.columns))
    present = rows.join(target.select(*keys), keys, "left_semi").select(*target.columns)
    absent = rows.join(target.select(*keys), keys, "left_anti").select(*target.columns)
    if strategy == "insert":
        return target.unionByName(absent), present.unionByName(unclear)
    kept = target.join(rows.select(*keys), keys, "left_anti").select(*target.columns)
    if strategy == "upsert":
        return kept.unionByName(rows), unclear
    if strategy == "update":
        updated = target.join(present.select(*keys), keys, "left_anti").select(*target.columns)
        return updated.unionByName(present), absent.unionByName(unclear)
    raise ValueError(f"unknown strategy: {strategy}")


def batch_number(
    changes: DataFrame, *, by: str = "op", order: list[str] | None = None, size: int = BATCH_SIZE,
    slices: int | None = None,
) -> DataFrame:
    """Numbers batches of ``size`` changes per operation, in LSN order, from 0."""
    if not 1 <= size <= MAX_BATCH_SIZE:
        raise ValueError(f"batch size must be between 1 and {MAX_BATCH_SIZE}")
    ranked = ordered_scan(changes, [by], order or ["lsn"], rank="__rank", slices=slices)
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def group_by_operation(
    changes: DataFrame, row: Column, *, order: list[str] | None = None, size: int = BATCH_SIZE,
    slices: int | None = None,
) -> DataFrame:
    """Write batches per operation; ``rows`` holds at most ``size`` entries."""
    order = order or ["lsn"]
    numbered = batch_number(changes, order=order, size=size, slices=slices)
    return numbered.groupBy("op", "batch").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct(*order, row.alias("row")))).alias("rows"))


def group_transactions(
    changes: DataFrame, row: Column, *, max_rows: int = MAX_BATCH_SIZE, slices: int | None = None
) -> DataFrame:
    """Changes of a transaction as one ordered unit.

    A transaction longer than ``max_rows`` comes in parts 0, 1, ..., ``n_parts`` - 1, none of which is
    ever larger, so a huge transaction does not become one huge row.
    """
    ranked = ordered_scan(changes, ["txid"], ["lsn"], rank="__rank", totals={"n_changes": F.lit(1).cast("bigint")},
                          slices=slices)
    parted = ranked.withColumns({
        "part": F.floor((F.col("__rank") - 1) / max_rows),
        "n_parts": F.ceil(F.col("n_changes") / max_rows),
    })
    return parted.groupBy("txid", "part", "n_parts", "n_changes").agg(
        F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"),
        F.array_sort(F.collect_list(F.struct("lsn", row.alias("row")))).alias("changes"))


def change_images(changes: DataFrame, keys: list[str], value: str, *, slices: int | None = None) -> DataFrame:
    """Before and after values of each change; the before image is what the previous change left."""
    left = F.when(F.col("op") != "D", F.col(value))
    seen = ordered_scan(changes, keys, ["lsn"], previous={"before_value": left}, slices=slices)
    return seen.withColumn("after_value", left)
