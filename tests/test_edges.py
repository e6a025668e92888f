"""Inputs that the registered queries do not hold: malformed payloads, ties, repeats, NULLs, odd names."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from flowspark import functions as fn, operators as op, plans, sinks, sources
from flowspark.operators.converters import converted_and_failed
from flowspark.plans.flow import Flow


def messages(spark, payloads):
    rows = [(f"m{k}", "t", payload.encode(), "text/plain", len(payload)) for k, payload in enumerate(payloads)]
    return spark.createDataFrame(rows, "id string, tenant_id string, payload binary, content_type string, payload_size long")


def test_pre_releases_are_ordered_before_their_release(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2.a", "1.2.0-rc1", "1.2", "1.2.1", "v2.0.0", "10.0.0"]
    df = spark.createDataFrame([(v,) for v in ordered], "v string")
    found = [row.v for row in df.orderBy(fn.version_key(F.col("v"))).collect()]
    assert found == ["1.0.0-2.a", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", *ordered[4:]]
    kept = {row.v for row in df.filter(fn.in_range(F.col("v"), ">=1.2.0,<2.0.0")).collect()}
    assert kept == {"1.2", "1.2.1"}
    plugins = spark.createDataFrame([("p", "1.2.0"), ("p", "1.2.0-rc1")], "name string, version string")
    assert op.latest_version(plugins, ">=1.0.0").first().version == "1.2.0"


def test_large_integers_are_compared_exactly(spark):
    env = messages(spark, ['{"n": 9007199254740993}', '{"n": 9007199254740992}', '{"n": 1.5}', '{"n": 1e300}'])
    assert [row.id for row in op.filter_field(env, "$.n", "=", 9007199254740992).collect()] == ["m1"]
    assert [row.id for row in op.filter_field(env, "$.n", ">", 9007199254740992).collect()] == ["m0", "m3"]


def test_integers_of_a_schema(spark):
    env = messages(spark, ['{"n": 1.0}', '{"n": 12345678901234567890}', '{"n": 1.5}', '{"n": 7}', '{"n": "7"}'])
    checked = op.validate_payload(env, {"type": "object", "properties": {"n": {"type": "integer"}}})
    assert [row.id for row in checked.filter("size(payload_errors) > 0").collect()] == ["m2", "m4"]


def test_object_keys_stay_in_their_place_and_apart(spark, tmp_path):
    ids = ["a/b", "a_b", "..", ".", "a b", "a+b", "a%2Fb"]
    df = spark.createDataFrame([(i, t) for i in ids for t in ("../../esc", "t")], "id string, tenant string")
    keys = [row.k for row in df.select(fn.object_key(F.col("tenant"), F.col("id")).alias("k")).collect()]
    assert len(set(keys)) == len(keys) and not any(part in ("", ".", "..") for key in keys for part in key.split("/"))
    env = op.new_envelope(spark.createDataFrame(
        [("x/y", "../../esc", b"p" * 50), ("x_y", "../../esc", b"q" * 50)], "id string, tenant_id string, payload binary"),
        id=F.col("id"))
    back = sinks.resolve_payload_refs(sinks.offload_payloads(env, str(tmp_path / "store"), threshold=10), str(tmp_path / "store"))
    assert {row.id: bytes(row.payload) for row in back.collect()} == {"x/y": b"p" * 50, "x_y": b"q" * 50}
    assert {entry.name for entry in tmp_path.iterdir()} == {"store"}


def test_one_file_for_messages_of_one_path(spark, tmp_path):
    rows = [(f"m{k}", "same.txt", f"v{k}".encode(), "c", None, datetime.datetime(2024, 1, k + 1)) for k in range(3)]
    plan = spark.createDataFrame(rows, "id string, rel_path string, payload binary, checksum string, reject_reason string, "
                                       "created_at timestamp")
    report = {row.id: row.bytes for row in sinks.write_files(plan, str(tmp_path)).collect()}
    assert report == {"m0": None, "m1": None, "m2": 2} and (tmp_path / "same.txt").read_bytes() == b"v2"


def test_archive_folders_of_both_kinds_expire(tmp_path):
    for name in ("2024-01-01", "2024-03-01", "archive_date=2024-01-02", "other", "2024-01-01x"):
        (tmp_path / name).mkdir()
    gone = sinks.drop_expired_days(str(tmp_path), as_of=datetime.date(2024, 3, 2), days=30)
    assert gone == ["2024-01-01", "2024-01-02"]
    assert {entry.name for entry in tmp_path.iterdir()} == {"2024-03-01", "other", "2024-01-01x"}


def test_files_of_deeper_folders_of_the_same_name(spark, tmp_path):
    deep = tmp_path / "in" / "sub" / "in"
    deep.mkdir(parents=True)
    (deep / "b.json").write_text("b")
    (tmp_path / "in" / "a.json").write_text("a")
    assert [row.path.rsplit("/", 1)[1] for row in sources.read_files(spark, str(tmp_path / "in")).collect()] == ["a.json"]
    (deep / "c.bin").write_bytes(b"c")
    assert [row.key for row in sources.read_objects(spark, str(tmp_path / "in")).collect()] == ["sub/in/c.bin"]


@pytest.mark.parametrize("convert, good, bad", [
    (lambda env: op.map_json(env, {"a": "$.a", "c": {"const": "USD"}}), '{"a": 1}', "{broken"),
    (lambda env: op.json_to_xml(env, "a int"), '{"a": 1}', "no json"),
    (lambda env: op.xml_to_json(env, "a int"), "<ROW><a>1</a></ROW>", "<ROW><a>1"),
    (lambda env: op.csv_to_json(env, "a int, b string"), "1,x", "one,two,three,four")])
def test_malformed_payloads_stay_and_are_told(spark, convert, good, bad):
    done, failed = converted_and_failed(convert(messages(spark, [good, bad])))
    assert [row.id for row in done.collect()] == ["m0"]
    row = failed.first()
    assert row.id == "m1" and bytes(row.payload).decode() == bad and row.last_error.startswith("malformed")
    assert bytes(done.first().payload).decode() != good


def test_flows_leave_diverted_messages_alone(spark):
    env = op.new_envelope(spark.createDataFrame(
        [("ok", b'{"n": 5, "a": 1}'), ("small", b'{"n": 1, "a": 2}'), ("broken", b"{"), ("boom", b'{"n": 9, "a": 3}')],
        "id string, payload binary"), id=F.col("id"))
    seen = []

    def convert(message, context):
        if json.loads(message["payload"])["a"] == 3:
            raise ValueError("boom")
        return {"payload": b"changed"}

    flow = Flow([{"kind": "filter", "path": "$.a", "op": "in", "value": [1, 3, None]},
                 {"kind": "map_json", "mapping": {"a": "$.a"}}, {"kind": "convert", "function": "f"},
                 {"kind": "step", "name": "done"}], functions={"f": convert})
    found = {row.id: row for row in flow.annotate(env).collect()}
    assert {k: row.route for k, row in found.items()} == {
        "ok": "out", "small": "dropped", "broken": "dropped", "boom": "dead_letter"}
    assert bytes(found["small"].payload) == b'{"n": 1, "a": 2}' and bytes(found["broken"].payload) == b"{"
    assert bytes(found["ok"].payload) == b"changed" and bytes(found["boom"].payload) == b'{"a":3}'
    assert found["boom"].last_error == "ValueError: boom" and not found["small"].step_history and not seen
    broken = Flow([{"kind": "map_json", "mapping": {"c": {"const": "USD"}}}]).annotate(env).filter("id = 'broken'").first()
    assert (broken.route, bytes(broken.payload), broken.last_error) == ("dead_letter", b"{", "malformed JSON")


def test_every_route_needs_a_sink(spark):
    steps = [{"kind": "route", "default": "rest", "rules": [{"to": "big", "path": "$.n", "op": ">", "value": 1}]}]
    for name in ("big", "rest"):
        with pytest.raises(ValueError, match=f"no sink for route: {name}"):
            plans.run_flow(spark, {"source": {"type": "envelopes", "options": {"path": "x"}}, "steps": steps,
                                   "sinks": {other: None for other in ("big", "rest") if other != name}})


def test_unclear_rows_are_conflicts(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    incoming = spark.createDataFrame([(2, "b"), (2, "c"), (None, "d"), (3, "e"), (1, "f")], "k int, v string")
    for strategy, merged, conflicts in (
            ("insert", {(1, "a"), (3, "e")}, {"b", "c", "d", "f"}), ("upsert", {(1, "f"), (3, "e")}, {"b", "c", "d"}),
            ("update", {(1, "f")}, {"b", "c", "d", "e"})):
        done, bad = op.merge_rows(target, incoming, ["k"], strategy)
        assert {tuple(row) for row in done.collect()} == merged and {row.v for row in bad.collect()} == conflicts


def test_user_filters_see_messages_as_they_are(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, 5, []), (3, 0, None)], "id int, n int, tags array<string>")

    def check(message, context):
        return message["n"] is None and message["tags"] == ["a"] or 10 / message["n"] > 1

    found = {row.id: (row.passes, row.filter_error) for row in op.decide_with(df, check).collect()}
    assert found == {1: (True, None), 2: (True, None), 3: (False, "ZeroDivisionError: division by zero")}
    assert [row.id for row in op.filter_with(df, check).collect()] == [1, 2]
