"""Polls of a folder, with files that change, fail and wait; and the settings of folder components."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import plans, sources
from flowspark.plans.folders import seconds_of

T0 = datetime(2100, 1, 1)


@pytest.fixture
def poll(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    counter = iter(range(100))

    def run(at_ms, **options):
        sent = tmp_path / f"sent{next(counter)}"
        as_of = F.lit(str(T0 + timedelta(milliseconds=at_ms))).cast("timestamp")
        report = plans.poll_folder(spark, str(inbox), lambda env: env.write.parquet(str(sent)), str(tmp_path / "state"),
                                   as_of=as_of, **options)
        actions = {row["name"]: (row["action"], row["attempts"]) for row in report.collect()}
        return actions, [row.asDict() for row in spark.read.parquet(str(sent)).collect()]

    return inbox, run


def test_versions_are_processed_once(poll):
    inbox, run = poll
    (inbox / "a.json").write_text('{"n":1}')
    (inbox / "b.txt").write_text("b")
    actions, sent = run(0)
    assert actions == {"a.json": ("process", 0), "b.txt": ("process", 0)}
    assert {(m["content_type"], bytes(m["payload"]), m["source"], m["payload_size"]) for m in sent} == {
        ("application/json", b'{"n":1}', "FileConsumer", 7), ("text/plain", b"b", "FileConsumer", 1)}
    assert run(1000) == ({"a.json": ("skip", 0), "b.txt": ("skip", 0)}, [])
    (inbox / "b.txt").write_text("b2")
    os.utime(inbox / "b.txt", (2_000_000_000, 2_000_000_000))
    actions, sent = run(2000)
    assert actions == {"a.json": ("skip", 0), "b.txt": ("process", 0)} and [bytes(m["payload"]) for m in sent] == [b"b2"]


def test_recent_files_are_left_alone(poll):
    inbox, run = poll
    (inbox / "a.txt").write_text("a")
    stamp = (T0 - timedelta(milliseconds=500) - datetime(1970, 1, 1)).total_seconds()
    os.utime(inbox / "a.txt", (stamp, stamp))
    assert run(0) == ({}, [])
    assert run(600)[0] == {"a.txt": ("process", 0)}


def test_unreadable_files_wait_and_end_in_the_error_folder(poll, tmp_path, monkeypatch):
    inbox, run = poll
    (inbox / "bad.txt").write_text("x")
    (inbox / "good.txt").write_text("y")
    from flowspark.sinks import files

    def refuse(store, path):
        if path.endswith("bad.txt"):
            raise PermissionError("permission denied")
        with open(path, "rb") as content:
            return content.read()

    monkeypatch.setattr(files, "get", refuse)
    options = dict(archive_dir=str(tmp_path / "archive"), error_dir=str(tmp_path / "error"), backoff_base_ms=1000)
    assert run(0, **options)[0] == {"bad.txt": ("retry", 1), "good.txt": ("process", 0)}
    assert run(500, **options)[0] == {"bad.txt": ("wait", 1)}
    assert run(1000, **options)[0] == {"bad.txt": ("retry", 2)}
    assert run(2500, **options)[0] == {"bad.txt": ("wait", 2)}
    assert run(3000, **options)[0] == {"bad.txt": ("error", 3)}
    assert list(inbox.iterdir()) == []
    assert (tmp_path / "archive/2100-01-01/good.txt").read_text() == "y"
    assert "permission denied" in (tmp_path / "error/2100-01-01/bad.txt.error").read_text()
    (inbox / "bad.txt").write_text("x")
    assert run(9_000_000, **options)[0] == {"bad.txt": ("gave_up", 3)}


@pytest.mark.parametrize("text, seconds", [
    ("5s", 5), ("100ms", 0.1), ("1m30s", 90), ("-2s", -2), ("soon", None), ("5", None), ("", None)])
def test_durations(text, seconds):
    assert seconds_of(text) == seconds


def test_source_settings():
    options = plans.file_source_options({})
    assert (options["pattern"], options["interval_seconds"], options["max_retries"], options["backoff_base_ms"],
            options["archive_days"], options["archive_dir"], options["delete"]) == ("*", 5, 3, 1000, 30, None, False)
    options = plans.file_source_options({
        "FILE_INPUT_DIR": "/x", "FILE_INPUT_MAX_RETRIES": "none", "FILE_INPUT_RETRY_BACKOFF_MS": "100",
        "FILE_INPUT_POLL_INTERVAL": "soon", "FILE_INPUT_DELETE_AFTER_PROCESSING": "true"})
    assert (options["folder"], options["max_retries"], options["backoff_base_ms"], options["interval_seconds"],
            options["delete"]) == ("/x", 3, 100, 5, True)
    for interval in ("-1s", "0s"):
        with pytest.raises(ValueError, match="poll interval"):
            plans.file_source_options({"FILE_INPUT_POLL_INTERVAL": interval})


def test_sink_settings():
    options = plans.file_sink_options({"FILE_OUTPUT_ORGANIZE_BY": "type", "FILE_OUTPUT_MAX_FILE_SIZE": "-5"})
    assert options["organize_by"] == "none" and options["max_size"] == 1024 ** 3
    settings = {"FILE_OUTPUT_ORGANIZE_BY": "type", "FILE_OUTPUT_CREATE_SUBDIRS": "True"}
    assert plans.file_sink_options(settings)["organize_by"] == "type"
    assert plans.file_sink_options({**settings, "FILE_OUTPUT_ORGANIZE_BY": "size"})["organize_by"] == "none"


def test_flow_runs_from_the_command_line(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"n":1}')
    environ = {**os.environ, "PYTHONPATH": os.getcwd(), "INPUT_TYPE": "file", "OUTPUT_TYPE": "file",
               "INPUT_CONFIG": json.dumps({"path": str(tmp_path / "in")}),
               "OUTPUT_CONFIG": json.dumps({"path": str(tmp_path / "out"), "filename": "copy.{{.Extension}}"})}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-m", "flowspark"], cwd=root, env=environ, capture_output=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert (tmp_path / "out/copy.json").read_text() == '{"n":1}'


def test_empty_files_are_landed_and_polled(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    for name, content in (("a.json", "{}"), ("b.json", ""), ("c.txt", ""), ("sub/d.json", ""), (".e.json", ""), ("_f.json", "")):
        (inbox / name).write_text(content)
    rows = sources.read_files(spark, str(inbox), "*.json").collect()
    found = {row.path.rsplit("/", 1)[1]: (row.length, bytes(row.content)) for row in rows}
    assert len(rows) == 2 and found == {"a.json": (2, b"{}"), "b.json": (0, b"")}
    at = {row.path.rsplit("/", 1)[1]: row.modificationTime for row in rows}
    assert abs((at["b.json"] - at["a.json"]).total_seconds()) < 60
    sent = tmp_path / "sent"
    actions = []
    for number in range(2):
        report = plans.poll_folder(
            spark, str(inbox), lambda env: env.write.mode("append").parquet(str(sent)), str(tmp_path / "state"),
            as_of=F.lit(f"2100-01-0{number + 1} 00:00:00").cast("timestamp"), pattern="*.txt", stage_dir=str(tmp_path / f"stage{number}"),
            archive_dir=str(tmp_path / "archive"))
        actions += [(row.name, row.action) for row in report.collect()]
    assert actions == [("c.txt", "process")] and not (inbox / "c.txt").exists()
    assert [bytes(row.payload) for row in spark.read.parquet(str(sent)).collect()] == [b""]
