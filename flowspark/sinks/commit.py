"""Files of messages in two steps: written aside by tasks, published by their commit.

A Python data source writes the files. Each task writes its files to a folder of its own attempt below ``_staging/<job>`` and,
last, a manifest of them; its commit message names that manifest. When all tasks are done the driver, which knows the attempt
that counts of each, writes one list of their manifests: the job's commit. Then a Spark job moves the listed files to their
places and the stage is removed. What failed or repeated tasks leave is in no committed manifest and goes with the stage; a
job that fails has no commit and leaves nothing. Publishing can be done again: a file moved before counts as done, and
``finish_files`` does so for jobs whose driver was lost between the commit and the last move.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.registry import use
from .files import latest_per_path
from .storage import children, exists, get, moved, open_store, put, put_aside

STAGING = "_staging"
MANIFEST = "id string, rel_path string, bytes bigint, checksum string, staged string"


@dataclass
class Attempt(WriterCommitMessage):
    manifest: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    """Rows (id, rel_path, payload, checksum) as files below ``path``; nothing is at its place before the job's commit."""

    def __init__(self, options: dict):
        for name in ("path", "job"):
            if not options.get(name):
                raise ValueError(f"missing option: {name}")
        self.path, self.job = options["path"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        context = TaskContext.get()
        own = f"task-{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        store, root = open_store(self.path)
        folder, lines = f"{root}/{STAGING}/{self.job}/{own}", []
        for batch in iterator:
            for row in batch.select(["id", "rel_path", "payload", "checksum"]).to_pylist():
                staged = f"{STAGING}/{self.job}/{own}/{len(lines)}"
                put_aside(store, f"{folder}/{len(lines)}", row["payload"])
                lines.append(json.dumps({"id": row["id"], "rel_path": row["rel_path"], "bytes": len(row["payload"]),
                                         "checksum": row["checksum"], "staged": staged}))
        put(store, f"{folder}.json", "".join(f"{line}\n" for line in lines).encode())
        return Attempt(f"{own}.json", len(lines))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.path)
        listed = "\n".join(sorted(message.manifest for message in messages if message is not None))
        put(store, f"{root}/{STAGING}/{self.job}/_COMMITTED", listed.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.path)
        if exists(store, f"{root}/{STAGING}/{self.job}"):
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


class MessageFiles(DataSource):
    """To be written to; options ``path`` and ``job``."""

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(dict(self.options))


def _published(spark: SparkSession, out_dir: str, job: str, report_dir: str) -> DataFrame:
    """Moves the files of a committed job to their places, in tasks; returns what was written."""
    store, root = open_store(out_dir)
    stage = f"{out_dir.rstrip('/')}/{STAGING}/{job}"
    manifests = get(store, f"{root}/{STAGING}/{job}/_COMMITTED").decode().split("\n")  # a name a task

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = open_store(out_dir)
        for batch in batches:
            for row in batch.select(["rel_path", "staged"]).to_pylist():
                source, target = f"{place}/{row['staged']}", f"{place}/{row['rel_path']}"
                moved(files, source, target)
            yield batch.select(["id", "rel_path", "bytes", "checksum"])

    listed = spark.read.schema(MANIFEST).json([f"{stage}/{name}" for name in manifests if name])
    report = listed.mapInArrow(move, "id string, rel_path string, bytes bigint, checksum string")
    report.write.mode("overwrite").parquet(report_dir)
    store.delete_dir(f"{root}/{STAGING}/{job}")
    if not children(store, f"{root}/{STAGING}"):
        store.delete_dir(f"{root}/{STAGING}")
    return spark.read.schema(report.schema).parquet(report_dir)


def write_files_committed(plan: DataFrame, out_dir: str, *, report_dir: str | None = None, job: str | None = None) -> DataFrame:
    """One file per accepted message of a plan, all of them or none; returns (id, rel_path, bytes, checksum) of those written.

    Of several messages for one path the newest is written. ``job`` names the write: the same name again replaces what an
    earlier try left.
    """
    spark, job = plan.sparkSession, job or uuid.uuid4().hex
    accepted = latest_per_path(plan.filter(F.col("reject_reason").isNull()))
    store, root = open_store(out_dir)
    if exists(store, f"{root}/{STAGING}/{job}"):
        store.delete_dir(f"{root}/{STAGING}/{job}")
    accepted.select("id", "rel_path", "payload", "checksum").write.format(use(spark, MessageFiles)).options(
        path=out_dir, job=job).mode("append").save()
    return _published(spark, out_dir, job, report_dir or f"{out_dir.rstrip('/')}/_reports/{job}")


def finish_files(spark: SparkSession, out_dir: str) -> list[str]:
    """Publishes the jobs that were committed but not moved to the end; stages without a commit are removed. Returns their names."""
    store, root = open_store(out_dir)
    done = []
    for job in children(store, f"{root}/{STAGING}"):
        if exists(store, f"{root}/{STAGING}/{job}/_COMMITTED"):
            _published(spark, out_dir, job, f"{out_dir.rstrip('/')}/_reports/{job}")
            done.append(job)
        else:
            store.delete_dir(f"{root}/{STAGING}/{job}")
    return sorted(done)
