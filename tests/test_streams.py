"""Streams in several micro-batches against their batch twins; timers; restarts."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import operators as op, plans, sources, streaming
from flowspark.sources.registry import register_sink

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def session(spark):
    return streaming.stream_session(spark, 4, timers=False)


def land(spark, df, folder, order, parts=3):
    """Writes ``df`` as ``parts`` files, one after the other, so that they arrive in order."""
    total = df.count()
    ranked = op.ordered_scan(df, [], [order], rank="__n")
    for part in range(parts):
        low, high = part * total // parts, (part + 1) * total // parts
        (ranked.filter(F.col("__n").between(low + 1, high)).drop("__n").coalesce(1)
         .write.mode("append").parquet(str(folder)))
    return df.schema


def read_stream(session, folder, schema):
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    """A third of the arrivals belong to one message."""
    return spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("message_id"), F.col("id").alias("seq"),
        (F.xxhash64("id") % 10 > 2).alias("failed"), F.timestamp_seconds(F.col("id") * 17).alias("ts"))


def test_message_states_equal_their_twin(spark, session, log, tmp_path):
    schema = land(spark, log, tmp_path / "in", "seq")
    tracked = streaming.track_messages(read_stream(session, tmp_path / "in", schema), order=["seq"])
    found = streaming.run_to_table(tracked, f"{tmp_path}/out", f"{tmp_path}/c")
    twin = op.retry_history(log, order=["seq"], failed=F.col("failed"))
    names = ["message_id", "seq", "outcome", "retry_count"]
    assert rows(found.select(*names)) == rows(twin.select(*names))
    assert {row["outcome"] for row in twin.collect()} == {"completed", "retry", "dead_letter"}


def test_locks_equal_their_twin(spark, session, log, tmp_path):
    arrivals = log.select(F.col("message_id").alias("id"), "ts")
    schema = land(spark, arrivals, tmp_path / "in", "ts")
    opened = streaming.dedupe_message_stream(read_stream(session, tmp_path / "in", schema), ttl_seconds=300)
    found = streaming.run_to_table(opened, f"{tmp_path}/out", f"{tmp_path}/c")
    twin = op.dedupe_messages(arrivals, ttl_seconds=300)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    assert rows(found.select("id", stamp)) == rows(twin.select("id", stamp))


def test_file_versions_equal_their_twin(spark, session, log, tmp_path):
    arrivals = log.select(
        F.col("message_id").alias("name"), "seq", F.col("failed").cast("string").alias("head_sha256"),
        F.lit(0).cast("bigint").alias("mtime_s"), F.lit(False).alias("failed"), F.col("seq").alias("seen_ms"))
    schema = land(spark, arrivals, tmp_path / "in", "seq")
    tracked = streaming.track_files(read_stream(session, tmp_path / "in", schema), order=["seq"])
    found = streaming.run_to_table(tracked, f"{tmp_path}/out", f"{tmp_path}/c")
    twin = op.dedupe_files(arrivals, version=["head_sha256", "mtime_s"], order=["seq"], keep_all=True)
    assert rows(found.select("seq", (F.col("action") == "process").alias("is_new"))) == rows(twin.select("seq", "is_new"))


def test_failing_files_wait_and_are_given_up(spark, session, tmp_path):
    sightings = [  # name, seq, sha, failed, seen_ms, expected
        ("f", 1, "a", True, 0, "retry"), ("f", 2, "a", True, 500, "wait"), ("f", 3, "a", True, 1000, "retry"),
        ("f", 4, "a", False, 2500, "wait"), ("f", 5, "a", False, 3000, "process"), ("f", 6, "a", False, 9000, "skip"),
        ("g", 7, "a", True, 0, "retry"), ("g", 8, "a", True, 10_000, "retry"), ("g", 9, "a", True, 20_000, "error"),
        ("g", 10, "a", False, 90_000, "gave_up")]
    df = spark.createDataFrame([row[:5] for row in sightings],
                               "name string, seq int, head_sha256 string, failed boolean, seen_ms bigint")
    df = df.withColumn("mtime_s", F.lit(0).cast("bigint"))
    schema = land(spark, df, tmp_path / "in", "seq")
    tracked = streaming.track_files(read_stream(session, tmp_path / "in", schema), order=["seq"])
    found = streaming.run_to_table(tracked, f"{tmp_path}/out", f"{tmp_path}/c")
    assert rows(found.select("seq", "action")) == [(row[1], row[5]) for row in sightings]


def test_rates_equal_their_twin(spark, session, log, tmp_path):
    env = log.select(F.col("message_id").alias("tenant_id"), F.col("ts").alias("created_at"))
    schema = land(spark, env, tmp_path / "in", "created_at")
    stream = read_stream(session, tmp_path / "in", schema).withWatermark("created_at", "1 hour")
    found = streaming.run_complete(op.message_rate(stream, slide="1 minute"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert rows(found) == rows(op.message_rate(env, slide="1 minute"))


def test_transactions_come_whole(spark, session, tmp_path):
    changes = spark.range(100).select(
        F.floor(F.col("id") / 10).alias("txid"), F.col("id").alias("lsn"), F.col("id").cast("string").alias("row"),
        ((F.col("id") % 10 == 9) & (F.col("id") < 95)).alias("is_last"))
    schema = land(spark, changes, tmp_path / "in", "lsn", parts=7)
    emitted = streaming.batch_transactions(read_stream(session, tmp_path / "in", schema))
    found = streaming.run_to_table(emitted, f"{tmp_path}/out", f"{tmp_path}/c")
    numbered = streaming.ordered_transactions(found)
    assert rows(numbered.select("txid", "position", "lsn", "complete")) == [
        (n // 10, n % 10 + 1, n, True) for n in range(90)]


def test_transactions_time_out(spark, tmp_path):
    timed = streaming.stream_session(spark, 2)
    changes = spark.range(5).select(F.lit(1).cast("bigint").alias("txid"), F.col("id").alias("lsn"),
                                    F.lit("r").alias("row"), F.lit(False).alias("is_last"))
    schema = land(spark, changes, tmp_path / "in", "lsn", parts=1)
    emitted = streaming.batch_transactions(read_stream(timed, tmp_path / "in", schema), timeout_ms=200)
    found = streaming.run_until(emitted, f"{tmp_path}/out", f"{tmp_path}/c", 5)
    assert rows(found.select("lsn", "complete")) == [(n, False) for n in range(5)]


def test_retries_are_released_after_their_backoff(spark, tmp_path):
    timed = streaming.stream_session(spark, 2)
    failures = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "id string, attempts int")
    schema = land(spark, failures, tmp_path / "in", "attempts", parts=1)
    began = time.monotonic()
    waiting = streaming.schedule_retries(read_stream(timed, tmp_path / "in", schema), base_ms=500)
    found = streaming.run_until(waiting, f"{tmp_path}/out", f"{tmp_path}/c", 3)
    assert rows(found.select("id", "action")) == [("a", "release"), ("b", "release"), ("c", "give_up")]
    assert time.monotonic() - began >= 2.0


def test_files_arrive_once(spark, session, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/f{n}.txt").write_text(f"body {n}")
    (tmp_path / "in/other.json").write_text("{}")
    seen = {"state_dir": str(tmp_path / "state"), "settle": 0}
    files = sources.stream_files(session, str(tmp_path / "in"), "*.txt", **seen)
    env = op.files_to_envelopes(files, created_at=F.col("modificationTime")).select("content_type", "payload_size")
    found = streaming.run_to_table(env, f"{tmp_path}/out", f"{tmp_path}/c")
    assert rows(found) == [("text/plain", 6)] * 3
    (tmp_path / "in/f3.txt").write_text("body 3!")
    again = op.files_to_envelopes(sources.stream_files(session, str(tmp_path / "in"), "*.txt", **seen)).select(
        "content_type", "payload_size")
    assert rows(streaming.run_to_table(again, f"{tmp_path}/out", f"{tmp_path}/c")) == [
        ("text/plain", 6)] * 3 + [("text/plain", 7)]


def test_a_batch_is_handled_once(spark, session, tmp_path):
    schema = land(spark, spark.range(9), tmp_path / "in", "id")
    seen = []

    def handle(batch, batch_id):
        seen.append((batch_id, batch.count()))
        if len(seen) == 2:
            raise RuntimeError("lost")

    for attempt in range(2):
        run = streaming.for_each_batch_once(
            read_stream(session, tmp_path / "in", schema), handle, f"{tmp_path}/c", availableNow=True)
        if attempt == 0:
            with pytest.raises(Exception, match="lost"):
                run.awaitTermination()
        else:
            run.awaitTermination()
    assert seen == [(0, 3), (1, 3), (1, 3), (2, 3)]


def test_change_stream_keeps_versions(spark, session, tmp_path):
    base = session.createDataFrame([(1, "one"), (2, "two")], "k bigint, v string")
    feed = spark.createDataFrame(
        [(1, 1, "U", "uno"), (2, 3, "I", "three"), (3, 2, "D", None), (4, 3, "U", "tres"), (5, 2, "I", "dos"), (6, 1, "D", None)],
        "lsn bigint, k bigint, op string, v string")
    schema = land(spark, feed, tmp_path / "in", "lsn")
    stream, root = read_stream(session, tmp_path / "in", schema), f"{tmp_path}/t"
    streaming.apply_change_stream(
        stream, base, root, ["k"], f"{tmp_path}/c", merge_every=2, availableNow=True).awaitTermination()
    base = spark.createDataFrame(base.collect(), base.schema)
    versions = [rows(streaming.read_replica(spark, base, stream, root, ["k"], n)) for n in (-1, 0, 1, 2, None)]
    assert versions == [
        [(1, "one"), (2, "two")], [(1, "uno"), (2, "two"), (3, "three")], [(1, "uno"), (3, "tres")],
        [(2, "dos"), (3, "tres")], [(2, "dos"), (3, "tres")]]
    # A version has the last change of each key, deletions too; only the keys that changed are in it.
    merged = spark.read.parquet(f"{root}/version=1")
    assert sorted(row.lsn for row in merged.collect()) == [1, 3, 4]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["log", "version=1"]
    assert versions[-1] == rows(op.apply_changes(base, feed, ["k"]))


def test_changes_that_come_again_do_not_win(spark, session, tmp_path):
    base = session.createDataFrame([(1, "one"), (2, "two")], "k bigint, v string")
    feed = spark.createDataFrame(
        [(1, 9, 1, "U", "new"), (2, 8, 2, "D", None), (3, 5, 1, "U", "old"), (4, 4, 2, "U", "old"), (5, 9, 1, "U", "new"),
         (6, 5, 1, "U", "old")], "number bigint, lsn bigint, k bigint, op string, v string")
    schema = land(spark, feed, tmp_path / "in", "number")
    stream, root = read_stream(session, tmp_path / "in", schema), f"{tmp_path}/t"
    streaming.apply_change_stream(
        stream, base, root, ["k"], f"{tmp_path}/c", merge_every=2, availableNow=True).awaitTermination()
    base = spark.createDataFrame(base.collect(), base.schema)
    assert rows(streaming.read_replica(spark, base, stream, root, ["k"])) == [(1, "new")]


def test_rate_limits_of_a_stream(spark, session, tmp_path):
    minute = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("id") * 10)
    feed = spark.range(60).select(minute.alias("ts"), F.lit("k").alias("key"), F.col("id").alias("number"))
    schema = land(spark, feed, tmp_path / "in", "number")
    flags = op.stream_rate_limit_flags(read_stream(session, tmp_path / "in", schema), limit=4)
    found = streaming.run_to_table(flags, f"{tmp_path}/out", f"{tmp_path}/c").collect()
    # The last minutes stay open until later requests move the watermark past them.
    assert 5 <= len({row.minute for row in found}) == len(found) < 10 and {(row.requests, row.beyond_limit) for row in found} == {(6, 2)}


def test_flow_stream_sends_every_batch(spark, session, tmp_path):
    env = op.new_envelope(
        spark.range(30).select(F.col("id").cast("string").alias("id"),
                               F.concat(F.lit('{"n":'), "id", F.lit("}")).cast("binary").alias("payload"),
                               F.col("id").alias("number")),
        created_at=F.lit(T0).cast("timestamp"))
    schema = land(spark, env, tmp_path / "in", "number")
    sent = []
    register_sink("counting", lambda part, options: sent.append((options["name"], part.count())))
    run = plans.run_flow_stream(read_stream(session, tmp_path / "in", schema), {
        "steps": [{"kind": "route", "default": "low", "rules": [{"to": "high", "path": "$.n", "op": ">=", "value": 15}]}],
        "sinks": {name: {"type": "counting", "options": {"name": name}} for name in ("low", "high")},
    }, f"{tmp_path}/stage", f"{tmp_path}/c", availableNow=True)
    run.awaitTermination()
    assert sent == [("low", 10), ("high", 0), ("low", 5), ("high", 5), ("low", 0), ("high", 10)]
