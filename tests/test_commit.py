"""Files by a committing writer: tasks and jobs that fail or repeat leave nothing behind."""

import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark import sinks
from flowspark.operators import new_envelope
from flowspark.sinks import commit
from flowspark.sinks.commit import FilesWriter


def plan(spark, rows, template="{{.ID}}.{{.Extension}}"):
    df = spark.createDataFrame(rows, "id string, payload binary").select("*", F.lit("text/plain").alias("content_type"), F.lit("").alias("source"))
    return sinks.plan_file_output(new_envelope(df, created_at=F.lit("2024-01-31 00:00:00").cast("timestamp")), template)


def found(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in pathlib.Path(folder).rglob("*")
            if p.is_file() and "_reports" not in p.parts and not p.name.startswith(".")}


def test_files_are_written_and_reported(spark, tmp_path):
    rows = [(f"m{k}", bytearray(b"x" * k)) for k in range(40)] + [("", bytearray(b"no id"))]
    report = sinks.write_files_committed(plan(spark, rows), str(tmp_path / "out"))
    assert found(tmp_path / "out") == {f"m{k}.txt": b"x" * k for k in range(1, 40)}  # one is empty, one has no id
    assert sorted((row.id, row.bytes) for row in report.collect()) == sorted((f"m{k}", k) for k in range(1, 40))
    assert not (tmp_path / "out/_staging").exists()


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").cast("string").alias("id"), F.lit("body").cast("binary").alias("payload"), F.lit("c").alias("checksum"),
        F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise(F.concat("id", F.lit(".txt"))).alias("rel_path"),
        F.lit(None).cast("string").alias("reject_reason"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files_committed(rows, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {}


class Task:
    def __init__(self, partition, attempt):
        self.partition, self.attempt = partition, attempt

    def partitionId(self):
        return self.partition

    def taskAttemptId(self):
        return self.attempt


def batch(*names):
    return pa.RecordBatch.from_pylist([{"id": n, "rel_path": f"{n}.txt", "payload": n.encode(), "checksum": "c"} for n in names])


def test_failed_and_repeated_attempts_are_not_published(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    writer = FilesWriter({"path": out, "job": "j"})

    def attempt(partition, number, batches):
        monkeypatch.setattr(commit.TaskContext, "get", classmethod(lambda cls: Task(partition, number)))
        return writer.write(iter(batches))

    def broken():
        yield batch("a", "b")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        attempt(0, 1, broken())  # died after two files
    first = attempt(0, 2, [batch("a", "b", "c")])
    attempt(1, 3, [batch("d", "stray")])  # ended, but another attempt of the task counts
    second = attempt(1, 4, [batch("d")])
    writer.commit([first, second, None])
    assert commit.finish_files(spark, out) == ["j"]  # the driver was lost after the commit
    assert found(out) == {f"{n}.txt": n.encode() for n in "abcd"}
    assert commit.finish_files(spark, out) == []


def test_publishing_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    writer = FilesWriter({"path": out, "job": "j"})
    monkeypatch.setattr(commit.TaskContext, "get", classmethod(lambda cls: Task(0, 1)))
    writer.commit([writer.write(iter([batch("a", "b")]))])
    staged = next((tmp_path / "out/_staging/j").glob("task-*/0"))
    staged.rename(tmp_path / "out/a.txt")  # moved already
    assert commit.finish_files(spark, out) == ["j"] and found(out) == {"a.txt": b"a", "b.txt": b"b"}


def test_stages_without_commit_are_removed(spark, tmp_path):
    stray = tmp_path / "out/_staging/lost/task-0-1-x"
    stray.mkdir(parents=True)
    (stray / "0").write_bytes(b"half")
    assert commit.finish_files(spark, str(tmp_path / "out")) == [] and found(tmp_path / "out") == {}


def test_the_newest_of_equal_paths_and_the_same_job_again(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("a", bytearray(b"first")), ("b", bytearray(b"second"))]
    for _ in range(2):
        sinks.write_files_committed(plan(spark, rows, "same.{{.Extension}}"), out, job="batch-7")
    assert found(out) == {"same.txt": b"second"}
    for missing in ({"path": out}, {"job": "j"}):
        with pytest.raises(ValueError):
            FilesWriter(missing)


def test_no_rows(spark, tmp_path):
    assert sinks.write_files_committed(plan(spark, []), str(tmp_path / "out")).count() == 0
