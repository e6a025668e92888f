"""Watching a folder by polls: every poll is one batch job with its memory in a table of file states."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import sinks, sources
from ..functions import backoff_ms, file_fingerprint
from ..operators import drop_settling, files_to_envelopes
from ..session import shared_dir
from ..sinks.keyed import versions

STATE = ("name string, head_sha256 string, mtime timestamp, attempts int, last_error string, at timestamp")

# Settings of the folder source and their defaults.
SOURCE_SETTINGS = {
    "FILE_INPUT_DIR": "/tmp/file-input",
    "FILE_INPUT_PATTERN": "*",
    "FILE_INPUT_POLL_INTERVAL": "5s",
    "FILE_INPUT_ARCHIVE_DIR": "",
    "FILE_INPUT_ERROR_DIR": "",
    "FILE_INPUT_DELETE_AFTER_PROCESSING": "false",
    "FILE_INPUT_MAX_RETRIES": "3",
    "FILE_INPUT_RETRY_BACKOFF_MS": "1000",
    "FILE_INPUT_ARCHIVE_RETENTION_DAYS": "30",
}

# Settings of the folder sink and their defaults.
SINK_SETTINGS = {
    "FILE_OUTPUT_DIR": "/tmp/file-output",
    "FILE_OUTPUT_FILENAME_FORMAT": "{{.ID}}.{{.Extension}}",
    "FILE_OUTPUT_MAX_FILE_SIZE": "1073741824",
    "FILE_OUTPUT_CREATE_SUBDIRS": "false",
    "FILE_OUTPUT_ORGANIZE_BY": "none",
}

# Units of a duration text in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds_of(text: str) -> float | None:
    """``1m30s`` and the like in seconds, None where the text is no duration."""
    pieces = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text.lstrip("-"))
    if not pieces or "".join(map("".join, pieces)) != text.lstrip("-"):
        return None
    total = sum(float(number) * UNITS[unit] for number, unit in pieces)
    return -total if text.startswith("-") else total


def _settings(environ: Mapping[str, str], defaults: dict[str, str]) -> dict[str, str]:
    return {name: environ.get(name) or default for name, default in defaults.items()}


def _positive(text: str, default: str) -> int:
    return int(text) if text.isdecimal() and int(text) > 0 else int(default)


def file_source_options(environ: Mapping[str, str]) -> dict:
    """Options of ``poll_folder`` from settings; what cannot be read falls back to its default."""
    values = _settings(environ, SOURCE_SETTINGS)

    def number(name: str) -> int:
        return _positive(values[name], SOURCE_SETTINGS[name])

    interval = seconds_of(values["FILE_INPUT_POLL_INTERVAL"])
    if interval is None:
        interval = seconds_of(SOURCE_SETTINGS["FILE_INPUT_POLL_INTERVAL"])
    if interval <= 0:
        raise ValueError(f"the poll interval must be positive, not {interval} s")
    return {
        "folder": values["FILE_INPUT_DIR"], "pattern": values["FILE_INPUT_PATTERN"], "interval_seconds": interval,
        "archive_dir": values["FILE_INPUT_ARCHIVE_DIR"] or None, "error_dir": values["FILE_INPUT_ERROR_DIR"] or None,
        "delete": values["FILE_INPUT_DELETE_AFTER_PROCESSING"] == "true",
        "max_retries": number("FILE_INPUT_MAX_RETRIES"), "backoff_base_ms": number("FILE_INPUT_RETRY_BACKOFF_MS"),
        "archive_days": number("FILE_INPUT_ARCHIVE_RETENTION_DAYS"),
    }


def file_sink_options(environ: Mapping[str, str]) -> dict:
    """Options of the ``file`` sink type from settings."""
    values = _settings(environ, SINK_SETTINGS)
    organize_by = values["FILE_OUTPUT_ORGANIZE_BY"]
    if organize_by not in ("none", "type", "date", "source"):
        organize_by = "none"
    subfolders = values["FILE_OUTPUT_CREATE_SUBDIRS"].lower() == "true"
    return {
        "path": values["FILE_OUTPUT_DIR"], "filename": values["FILE_OUTPUT_FILENAME_FORMAT"],
        "organize_by": organize_by if subfolders else "none",
        "max_size": _positive(values["FILE_OUTPUT_MAX_FILE_SIZE"], SINK_SETTINGS["FILE_OUTPUT_MAX_FILE_SIZE"]),
    }


def poll_folder(
    spark: SparkSession, folder: str, send: Callable[[DataFrame], None], state_dir: str, *, as_of: Column,
    pattern: str = "*", archive_dir: str | None = None, error_dir: str | None = None, delete: bool = False,
    max_retries: int = 3, backoff_base_ms: int = 1000, stage_dir: str | None = None, shares: int = 1,
) -> DataFrame:
    """One poll: new versions of files become messages for ``send``; returns (name, action, attempts).

    ``process`` is a new version, ``skip`` the version processed last, ``retry`` a failed read to be tried
    again, ``wait`` one whose backoff is not over, ``error`` the last failure allowed, ``gave_up`` a file that
    has had it. Tasks list the files and read those that need it: of a file with the time it had, the head only, unless
    that differs. The state is a keyed table with a row a name, of which a poll replaces the buckets it changes.
    """
    stage = stage_dir or shared_dir(spark, "poll")
    known = _states(spark, state_dir)
    listing = drop_settling(sources.list_files(spark, folder, pattern, shares=shares), as_of=as_of).select(
        "path", "modificationTime", F.substring_index("path", "/", -1).alias("name"))
    failures = F.coalesce("attempts", F.lit(0))
    due = F.timestamp_add("MILLISECOND", backoff_ms(F.lit(backoff_base_ms), failures), F.col("at"))
    held = (F.when(failures >= max_retries, "gave_up")
            .when((failures > 0) & (due > as_of), "wait"))
    judged = listing.join(known, "name", "left").withColumns({"held": held, "failures": failures})

    as_before = (F.col("failures") == 0) & (F.date_trunc("second", "modificationTime") == F.col("mtime"))
    read = sinks.fetch_files(judged.filter(F.col("held").isNull()).withColumn(
        "expected", F.when(as_before, F.col("head_sha256"))), known="expected")
    version = file_fingerprint(F.col("content"), F.col("modificationTime"))
    failed = F.col("error").isNotNull()
    action = (F.when(failed & (F.col("failures") + 1 >= max_retries), "error").when(failed, "retry")
              .when(F.col("unchanged"), "skip").otherwise("process"))
    done = read.select(
        "path", "name", "modificationTime", F.col("error"), action.alias("action"),
        F.when(failed, F.col("failures") + 1).otherwise(0).alias("attempts"),
        version["head_sha256"].alias("head_sha256"), version["mtime"].alias("mtime"),
        F.when(action == "process", F.col("content")).alias("content"), F.uuid().alias("id"))
    held_back = judged.filter(F.col("held").isNotNull()).select(
        "path", "name", "modificationTime", F.col("held").alias("action"), F.col("failures").alias("attempts"))
    done = done.unionByName(held_back, allowMissingColumns=True)
    # Staged once: ids and decisions must not change between sending, remembering and moving.
    done.write.mode("overwrite").partitionBy("action").parquet(stage)
    staged = spark.read.schema(done.schema).parquet(stage)

    fresh = staged.filter(F.col("action") == "process")
    send(files_to_envelopes(fresh.select(
        "path", "modificationTime", F.octet_length("content").cast("bigint").alias("length"), "content", "id"),
        created_at=as_of).drop("path", "modificationTime"))
    sinks.write_keyed(staged.filter(F.col("action").isin("process", "retry", "error")).select(
        "name", "head_sha256", "mtime", "attempts", F.col("error").alias("last_error"), as_of.alias("at")), state_dir)
    sinks.vacuum(state_dir, keep=2)
    sinks.settle_files(
        staged.filter(F.col("action").isin("process", "error")).select("path", "error"), as_of=as_of,
        archive_dir=archive_dir, error_dir=error_dir, delete=delete, report_dir=f"{stage}/_settled")
    return staged.select("name", "action", "attempts")


def _states(spark: SparkSession, state_dir: str) -> DataFrame:
    if not versions(state_dir):
        sinks.create_keyed(state_dir, STATE, ["name"])
    return sinks.read_keyed(spark, state_dir)


def watch_folder(
    spark: SparkSession, send: Callable[[DataFrame], None], state_dir: str, *, folder: str, interval_seconds: float = 5.0,
    archive_dir: str | None = None, archive_days: int = 30, polls: int | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), sleep: Callable[[float], None] = time.sleep, **options,
) -> None:
    """Polls a folder every ``interval_seconds``, for ever or ``polls`` times; takes the options of ``file_source_options``.

    After each poll the archive loses the days that are older than ``archive_days``. A poll that takes longer than the interval
    is followed by the next one at once.
    """
    done = 0
    while polls is None or done < polls:
        began = clock()
        poll_folder(spark, folder, send, state_dir, archive_dir=archive_dir,
                    as_of=F.lit(began.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"), **options)
        if archive_dir:
            sinks.drop_expired_days(archive_dir, as_of=began.date(), days=archive_days)
        done += 1
        if done != polls:
            sleep(max(0.0, interval_seconds - (clock() - began).total_seconds()))
