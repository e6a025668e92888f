"""Failed deliveries: HTTP from options, the retry table, passes to the end."""

import io
import json
import pathlib
import urllib.error

import pytest
from pyspark.sql import functions as F

from flowspark import plans, sinks
from flowspark.operators import new_envelope
from flowspark.plans import retries
from flowspark.sources.registry import register_source


class Answer:
    def __init__(self, status):
        self.status = status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def messages(spark, ids):
    return new_envelope(spark.createDataFrame([(i, bytearray(b"body"), "") for i in ids], "id string, payload binary, content_type string"),
                        created_at=F.lit("2024-01-31 00:00:00").cast("timestamp"))


def test_sender_builds_requests_and_returns_refusals():
    seen = []

    def opener(request, timeout):
        seen.append((request.full_url, request.get_method(), request.data, dict(request.header_items()), timeout))
        if len(seen) == 2:
            raise urllib.error.HTTPError(request.full_url, 404, "gone", {}, io.BytesIO())
        if len(seen) == 3:
            raise TimeoutError("slow")
        return Answer(201)

    send = sinks.http_sender("https://x.example/a", method="PUT", timeout=7, opener=opener)
    assert send(b"one", {"X-Message-ID": "1"}) == 201
    assert seen[0] == ("https://x.example/a", "PUT", b"one", {"X-message-id": "1"}, 7)
    assert send(b"two", {}) == 404
    with pytest.raises(TimeoutError):
        send(b"three", {})


def test_http_options_and_their_defaults():
    plain = sinks.http_options({"url": "https://x.example"})
    assert plain["attempts"] == 1 and plain["headers"] == {}
    full = sinks.http_options(json.loads('{"url":"https://x.example","method":"PATCH","timeout":2,"retries":4,"headers":{"A":"b"}}'))
    assert full["attempts"] == 4 and full["headers"] == {"A": "b"}
    for bad in ({}, {"url": ""}, {"url": "u", "retries": 0}, {"url": "u", "timeout": 0}):
        with pytest.raises(ValueError):
            sinks.http_options(bad)


def test_flow_from_settings_to_an_endpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/o{n}.json").write_text(json.dumps({"n": n}))
    config = plans.load_config({
        "INPUT_TYPE": "file", "INPUT_CONFIG": json.dumps({"path": str(tmp_path / "in")}), "OUTPUT_TYPE": "http",
        "OUTPUT_CONFIG": json.dumps({"url": "https://x.example", "retries": 2, "backoff": 0})})
    got = tmp_path / "got"
    got.mkdir()

    def opener(request, timeout):
        body = json.loads(request.data)
        (got / f"{body['n']}-{len(list(got.glob(str(body['n']) + '-*')))}").write_text(request.get_header("X-message-id"))
        return Answer(500 if body["n"] == 1 else 200)

    config["sinks"]["out"]["options"]["opener"] = opener
    config |= {"retry_dir": str(tmp_path / "retry"), "retry": {"max_failures": 2, "initial_ms": 0}}
    plans.run_flow(spark, config)
    states = plans.drain_flow(spark, config, wait=lambda moment: F.timestamp_add("SECOND", F.lit(1), F.lit(moment).cast("timestamp")))
    assert sorted((row.state, row.failures) for row in states.collect()) == [("completed", 0), ("completed", 0), ("dead_letter", 2)]
    # Two tries in each of two deliveries for the one refused, one for the others, always under the same id.
    assert sorted(path.name for path in got.iterdir()) == ["0-0", "1-0", "1-1", "1-2", "1-3", "2-0"]
    assert len({(got / f"1-{k}").read_text() for k in range(4)}) == 1


def report(spark, rows):
    return spark.createDataFrame(rows, "id string, delivered boolean, status int, error string")


def test_passes_count_failures_and_wait(spark, tmp_path):
    at = lambda seconds: F.timestamp_add("SECOND", F.lit(seconds), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    home, policy = str(tmp_path / "retry"), retries.RetryPolicy(max_failures=2, initial_ms=4000)
    sent = messages(spark, ["a", "b", "c", "d"])
    retries.first_deliveries(sent, report(spark, [("a", True, 200, None), ("b", False, 503, "status 503"), ("c", False, None, "x"),
                                                  ("c", True, 200, None)]), home, "out", as_of=at(0), policy=policy)
    states = {row.id: row for row in retries.retry_states(spark, home).collect()}
    assert {i: (row.state, row.error) for i, row in states.items()} == {
        "a": ("completed", None), "b": ("retry", "status 503"), "c": ("completed", None), "d": ("retry", "no report")}
    calls = []

    def again(env, destination, number):
        calls.append((destination, number, sorted((row.id, row.retry_count) for row in env.select("id", "retry_count").collect())))
        return report(spark, [("b", True, 200, None), ("d", False, 500, "status 500")])

    assert retries.retry_pass(spark, home, {"out": again}, as_of=at(3), policy=policy) == 0  # none is due yet
    assert retries.retry_pass(spark, home, {"out": again}, as_of=at(4), policy=policy) == 2
    assert retries.retry_pass(spark, home, {"out": again}, as_of=at(11), policy=policy) == 0  # waits eight seconds now
    assert retries.retry_pass(spark, home, {}, as_of=at(12), policy=policy) == 1  # spent: no sink is needed
    assert calls == [("out", 1, [("b", 1), ("d", 1)])]
    last = {row.id: (row.state, row.failures, row.waited_ms) for row in retries.retry_states(spark, home).collect()}
    assert last == {"a": ("completed", 0, 0), "b": ("completed", 1, 4000), "c": ("completed", 0, 0), "d": ("dead_letter", 2, 12000)}


def test_a_pass_that_was_lost_is_done_again(spark, tmp_path):
    at, home = F.lit("2024-01-31 00:00:00").cast("timestamp"), str(tmp_path / "retry")
    retries.first_deliveries(messages(spark, ["a"]), report(spark, [("a", False, 500, "e")]), home, "out", as_of=at)
    pathlib.Path(home, "pass=1").mkdir()
    pathlib.Path(home, "pass=1", "part-0.parquet").write_bytes(b"half")  # without _SUCCESS it never was
    done = lambda env, destination, number: report(spark, [("a", True, 200, None)])
    assert retries.retry_pass(spark, home, {"out": done}, as_of=F.timestamp_add("DAY", F.lit(1), at)) == 1
    assert [row.state for row in retries.retry_states(spark, home).collect()] == ["completed"]


def test_compaction_keeps_what_is_open(spark, tmp_path):
    at, home = F.lit("2024-01-31 00:00:00").cast("timestamp"), str(tmp_path / "retry")
    assert retries.compact(spark, home) == -1 and retries.retry_states(spark, home) is None
    retries.first_deliveries(messages(spark, ["a", "b"]), report(spark, [("a", True, 200, None)]), home, "out", as_of=at)
    assert retries.compact(spark, home) == 1 and retries.passes(home) == [1]
    assert [(row.id, row.failures) for row in retries.retry_states(spark, home).collect()] == [("b", 1)]
    with pytest.raises(ValueError, match="no sink for route: out"):
        retries.retry_pass(spark, home, {}, as_of=F.timestamp_add("DAY", F.lit(1), at))


def test_sinks_without_report_are_not_retried(spark, tmp_path):
    register_source("two", lambda session, options: messages(session, ["a", "b"]))
    config = {"source": {"type": "two"}, "sinks": {"out": {"type": "envelopes", "options": {"path": str(tmp_path / "out")}}},
              "retry_dir": str(tmp_path / "retry")}
    plans.run_flow(spark, config)
    assert plans.drain_flow(spark, config) is None and spark.read.parquet(str(tmp_path / "out")).count() == 2
