"""Keyed tables in buckets, of which a write replaces only those it touches.

A table is a folder with data files below ``data/write=N/bucket=B`` and one manifest for each version, ``manifests/N.json``,
that says for each bucket which write holds it. The bucket of a row follows from a hash of its keys, so a write reads and
replaces the buckets of its own rows and leaves the files of all others where they are. Readers go by one manifest: writing
the next one, by a rename, is what makes a write visible, all of it at once, and older versions stay readable beside it until
``vacuum``. A write that is lost before leaves files that no manifest names; the same write done again replaces them.

The number of buckets is fixed when a table is made: choose it so that a bucket fits a task, some 100 MB. The driver holds
a manifest, a few bytes a bucket. There is one writer at a time: a second one that started from the same version fails.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.changes import last_change, merge_rows
from .storage import children, exists, get, open_store, put
from .tables import WriteConflict

BUCKETS = 64


class ConcurrentWrite(Exception):
    """Another writer has published a version since this one was read."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    #: Bucket -> number of the write that holds it; a bucket without rows may have none.
    held: dict[int, int] = field(default_factory=dict)
    #: The last batch of changes that was applied, -1 without any.
    batch: int = -1

    def text(self) -> bytes:
        return json.dumps({"version": self.version, "keys": self.keys, "buckets": self.buckets, "schema": self.schema.json(),
                           "held": {str(k): v for k, v in sorted(self.held.items())}, "batch": self.batch}).encode()


def versions(path: str) -> list[int]:
    store, root = open_store(path)
    return sorted(int(name[:-len(".json")]) for name in children(store, f"{root}/manifests") if name.endswith(".json")
                  and not name.startswith("."))


def manifest(path: str, version: int | None = None) -> Manifest:
    """A version of the table, the newest by default."""
    found = versions(path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no version {'' if version is None else version} of a keyed table in {path}")
    number = found[-1] if version is None else version
    store, root = open_store(path)
    read = json.loads(get(store, f"{root}/manifests/{number}.json"))
    return Manifest(read["version"], read["keys"], read["buckets"], T.StructType.fromJson(json.loads(read["schema"])),
                    {int(k): v for k, v in read["held"].items()}, read["batch"])


def _published(path: str, made: Manifest) -> Manifest:
    store, root = open_store(path)
    if exists(store, f"{root}/manifests/{made.version}.json"):
        raise ConcurrentWrite(f"version {made.version} of {path} is there already")
    put(store, f"{root}/manifests/{made.version}.json", made.text())
    return made


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_keyed(path: str, schema: T.StructType | str, keys: list[str], *, buckets: int = BUCKETS) -> Manifest:
    """An empty table, version 0."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    missing = sorted(set(keys) - set(schema.names))
    if missing or not keys or buckets < 1:
        raise ValueError(f"a keyed table needs buckets and keys among its columns: {missing or keys}")
    return _published(path, Manifest(0, list(keys), buckets, schema))


def _folders(path: str, held: Manifest, only: set[int] | None = None) -> list[str]:
    return [f"{path.rstrip('/')}/data/write={write}/bucket={bucket}" for bucket, write in sorted(held.held.items())
            if only is None or bucket in only]


def _rows(spark: SparkSession, path: str, held: Manifest, only: set[int] | None = None) -> DataFrame:
    folders = _folders(path, held, only)
    return spark.read.schema(held.schema).parquet(*folders) if folders else spark.createDataFrame([], held.schema)


def read_keyed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of one version; what is written later does not change them."""
    return _rows(spark, path, manifest(path, version))


def _replaced(
    incoming: DataFrame, path: str, old: Manifest, change, batch: int | None = None,
) -> tuple[Manifest, list[int]]:
    """Publishes the next version, in which the buckets of ``incoming`` hold ``change(their rows, incoming)``."""
    spark, number = incoming.sparkSession, old.version + 1
    place = bucket_of(old.keys, old.buckets)
    touched = sorted(row[0] for row in incoming.select(place).distinct().collect())  # no more than there are buckets
    if touched:
        merged = change(_rows(spark, path, old, set(touched)), incoming).select(*old.schema.names)
        # A task writes whole buckets, so a bucket is one file or, where it is large, a few.
        merged.withColumn("bucket", place).repartition(min(len(touched), 4096), "bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{path.rstrip('/')}/data/write={number}")
    store, root = open_store(path)
    made = {name for name in children(store, f"{root}/data/write={number}")} if touched else set()
    held = {k: v for k, v in old.held.items() if k not in touched}
    held |= {bucket: number for bucket in touched if f"bucket={bucket}" in made}
    new = Manifest(number, old.keys, old.buckets, old.schema, held, old.batch if batch is None else batch)
    return _published(path, new), touched


def write_keyed(
    incoming: DataFrame, path: str, *, strategy: str = "upsert", on_conflict: str = "fail",
) -> tuple[Manifest, list[int]]:
    """Merges ``incoming`` into the table; returns the new version and the buckets that were replaced.

    Strategies and conflicts are those of ``merge_rows``; with ``on_conflict="skip"`` rows that the strategy forbids are left
    out. Rows with a NULL key are conflicts, so they touch nothing but are reported.
    """
    old = manifest(path)
    rows = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])

    def change(target: DataFrame, fresh: DataFrame) -> DataFrame:
        merged, conflicts = merge_rows(target, fresh, old.keys, strategy)
        if on_conflict == "fail":
            example = conflicts.select(*old.keys).first()
            if example is not None:
                raise WriteConflict(f"{strategy}: {example.asDict()}")
        return merged

    return _replaced(rows, path, old, change)


# What a replica keeps beside the rows: the change each one comes from, and whether that was its deletion.
LSN, DELETED = "__lsn", "__deleted"


def create_replica(path: str, schema: T.StructType | str, keys: list[str], *, buckets: int = BUCKETS) -> Manifest:
    """An empty replica: a keyed table that changes are applied to."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    whole = T.StructType([*schema.fields, T.StructField(LSN, T.LongType()), T.StructField(DELETED, T.BooleanType())])
    return create_keyed(path, whole, keys, buckets=buckets)


def load_replica(rows: DataFrame, path: str, *, lsn: int = 0) -> tuple[Manifest, list[int]]:
    """The snapshot a replica starts from; any change after ``lsn`` wins over it."""
    return write_keyed(rows.withColumns({LSN: F.lit(lsn).cast("bigint"), DELETED: F.lit(False)}), path)


def apply_to_replica(changes: DataFrame, path: str, batch: int) -> tuple[Manifest, list[int]]:
    """Applies a batch of changes (columns of the table, ``op``, ``lsn``): of each key the last change by LSN stays.

    A batch that was applied before changes nothing. Changes that come again in a later batch, or late, lose against newer
    ones, since deleted keys are kept as such. Changes without a key are left out.
    """
    old = manifest(path)
    if batch <= old.batch:
        return old, []
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema if f.name not in (LSN, DELETED)]
    rows = changes.select(*columns, F.col("lsn").cast("bigint").alias(LSN), (F.col("op") == "D").alias(DELETED))
    return _replaced(rows.dropna(subset=old.keys), path, old,
                     lambda target, fresh: last_change(target.unionByName(fresh), old.keys, [LSN]), batch)


def read_replica_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return read_keyed(spark, path, version).filter(~F.col(DELETED)).drop(LSN, DELETED)


def vacuum(path: str, *, keep: int = 1) -> list[int]:
    """Removes all versions but the newest ``keep`` and the files that none of these holds; returns the versions removed."""
    found = versions(path)
    gone, left = found[:-keep], [manifest(path, number) for number in found[-keep:]]
    used = {(write, bucket) for held in left for bucket, write in held.held.items()}
    store, root = open_store(path)
    for number in gone:
        store.delete_file(f"{root}/manifests/{number}.json")
    for write in children(store, f"{root}/data"):
        number = int(write.split("=")[1])
        if number > found[-1]:
            continue  # a write under way
        buckets = [name for name in children(store, f"{root}/data/{write}") if name.startswith("bucket=")]
        unused = [name for name in buckets if (number, int(name.split("=")[1])) not in used]
        if len(unused) == len(buckets):
            store.delete_dir(f"{root}/data/{write}")
        else:
            for name in unused:
                store.delete_dir(f"{root}/data/{write}/{name}")
    return gone
