"""Folders listed by tasks, in batches and streams, and watched by polls."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowspark import plans, sinks, sources, streaming
from flowspark.sinks import storage
from flowspark.sources.listing import FolderReader, FolderStream, Share


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for name, content in (("a.json", "{}"), ("b.json", ""), ("c.txt", "c"), ("sub/d.json", "d"), (".e.json", "e"), ("_f.json", "f"),
                          ("_g=1.json", "g"), ("h.json._COPYING_", "h")):
        (folder / name).write_text(content)
    return folder


def names(df):
    return sorted((row.path.rsplit("/", 1)[1], row.length) for row in df.collect())


@pytest.mark.parametrize("shares", [1, 5])
def test_a_folder_is_listed_by_tasks(spark, inbox, shares):
    assert names(sources.list_files(spark, str(inbox), shares=shares)) == [("_g=1.json", 2 - 1), ("a.json", 2), ("b.json", 0), ("c.txt", 1)]
    assert names(sources.list_files(spark, str(inbox), "[ab].json", shares=shares)) == [("a.json", 2), ("b.json", 0)]
    # Paths and times are those of Spark's own listing.
    both = sources.list_files(spark, str(inbox)).join(sources.read_files(spark, str(inbox)), ["path", "modificationTime", "length"])
    assert both.count() == 4


def test_empty_files_are_read(spark, inbox):
    found = {row.path.rsplit("/", 1)[1]: bytes(row.content) for row in sources.read_files(spark, str(inbox), "*.json").collect()}
    assert found == {"_g=1.json": b"g", "a.json": b"{}", "b.json": b""}


def stream(spark, inbox, tmp_path, **options):
    session = streaming.stream_session(spark, timers=False)
    files = sources.stream_files(session, str(inbox), "*", state_dir=str(tmp_path / "state"), settle=0, tasks=2, **options)
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("body"), "error")
    return lambda: sorted(map(tuple, streaming.run_to_table(rows, f"{tmp_path}/out", f"{tmp_path}/check").select(
        "name", "body").collect()))


def test_files_and_versions_arrive_once_over_five_batches(spark, inbox, tmp_path):
    run = stream(spark, inbox, tmp_path, shares=3)
    expected = [("_g=1.json", "g"), ("a.json", "{}"), ("b.json", ""), ("c.txt", "c")]
    assert run() == expected and run() == expected  # nothing new in the second batch
    (inbox / "a.json").write_text('{"n":1}')  # another length
    os.utime(inbox / "b.json", (10**9, 10**9))  # another time, an old one
    (inbox / "old.txt").write_text("")
    os.utime(inbox / "old.txt", (5 * 10**8, 5 * 10**8))  # moved in under an old time
    expected += [("a.json", '{"n":1}'), ("b.json", ""), ("old.txt", "")]
    assert run() == sorted(expected)
    (inbox / "c.txt").unlink()
    assert run() == sorted(expected)
    (inbox / "c.txt").write_text("back")
    assert run() == sorted([*expected, ("c.txt", "back")])
    assert len(list((tmp_path / "state").iterdir())) <= 2  # listings of past ticks are gone


def test_a_repeated_task_gives_the_same_rows(inbox, tmp_path):
    reader = FolderStream({"path": str(inbox), "state": str(tmp_path / "state"), "pattern": "*.json"})
    read = lambda share: [row for batch in reader.read(share) for row in batch.to_pylist()]
    first = read(Share(0, 0, 10))
    (inbox / "late.json").write_text("x")
    assert read(Share(0, 0, 10)) == first and len(first) == 3
    assert [row["path"].rsplit("/", 1)[1] for row in read(Share(0, 10, 20))] == ["late.json"]
    reader.commit({"tick": 20})
    assert [path.name for path in (tmp_path / "state").iterdir()] == ["20"]
    assert reader.partitions({"tick": 5}, {"tick": 5}) == []


def test_recent_files_wait(inbox):
    ahead = (datetime.now() + timedelta(hours=1)).timestamp()
    for name in ("a.json", "c.txt"):
        os.utime(inbox / name, (ahead, ahead))
    reader = FolderReader({"path": str(inbox), "settle": "1"})
    for name in ("b.json", "_g=1.json"):
        os.utime(inbox / name, (10**9, 10**9))
    assert sorted(row["path"].rsplit("/", 1)[1] for batch in reader.read(Share(0)) for row in batch.to_pylist()) == ["_g=1.json", "b.json"]


@pytest.mark.parametrize("options", [{}, {"path": ""}])
def test_a_folder_is_required(options):
    with pytest.raises(ValueError, match="path"):
        FolderReader(options)
    with pytest.raises(ValueError):
        FolderStream({"path": "/x"})


def test_unchanged_files_are_read_no_further_than_their_head(spark, tmp_path):
    from flowspark.functions.envelopes import FINGERPRINT_BYTES
    big = os.urandom(FINGERPRINT_BYTES) + b"tail"
    (tmp_path / "big").write_bytes(big)
    rows = spark.createDataFrame([(str(tmp_path / "big"),)], "path string")
    digest = F.sha2(F.lit(big[:FINGERPRINT_BYTES]), 256)
    same = sinks.fetch_files(rows.withColumn("d", digest), known="d").first()
    assert (same.unchanged, same.content, same.error) == (True, None, None)
    other = sinks.fetch_files(rows.withColumn("d", F.lit("0")), known="d").first()
    assert other.unchanged is False and bytes(other.content) == big


def test_a_folder_is_watched(spark, inbox, tmp_path):
    moments = iter(datetime(2100, 1, 1, tzinfo=timezone.utc) + timedelta(days=20 * k, seconds=k) for k in range(20))
    sent, naps = [], []

    def send(env):
        sent.append(sorted((row.payload_size, row.content_type) for row in env.select("payload_size", "content_type").collect()))
        (inbox / f"n{len(sent)}.txt").write_text("n" * len(sent))

    options = plans.file_source_options({"FILE_INPUT_DIR": str(inbox), "FILE_INPUT_PATTERN": "*.txt",
                                         "FILE_INPUT_ARCHIVE_DIR": str(tmp_path / "archive"), "FILE_INPUT_POLL_INTERVAL": "5s"})
    now = [None]

    def clock():
        now[0] = next(moments) if len(sent) >= len(naps) and now[0] is None or len(sent) > len(naps) else now[0]
        return now[0]

    plans.watch_folder(spark, send, str(tmp_path / "state"), polls=3, clock=clock, sleep=lambda seconds: naps.append(seconds), **options)
    assert sent == [[(1, "text/plain")], [(1, "text/plain")], [(2, "text/plain")]] and len(naps) == 2
    assert len(list((tmp_path / "archive").iterdir())) == 2  # thirty days are kept: the first day has gone


@pytest.mark.parametrize("uri, known", [("/a", True), ("file:///a", True), ("s3a://b/c", True), ("hdfs://n/p", True), ("viewfs://s/p", False)])
def test_stores_that_tasks_can_open(uri, known):
    assert storage.listable(uri) is known


def test_paths_of_stores():
    store, path = storage.open_store("file:/a/b")
    assert path == "/a/b" and storage.open_store("/a/b")[1] == "/a/b"
