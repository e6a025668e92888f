"""Edge cases of batch operators, against plain Python where order matters."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import operators as op
from flowspark.operators import state

T0 = datetime(2024, 1, 1)


def values(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())


def brute_locks(arrivals, ttl):
    opened, out = {}, set()
    for key, at in sorted(arrivals):
        if key not in opened or at - opened[key] >= ttl:
            opened[key] = at
            out.add((key, at))
    return out


@pytest.fixture(scope="module")
def arrivals():
    """One key with dense arrivals and a third of the rows, others sparse; ties and exact gaps included."""
    pick = random.Random(3)
    rows = [("hot", T0 + timedelta(seconds=pick.randrange(0, 20_000))) for _ in range(700)]
    rows += [(f"k{pick.randrange(40)}", T0 + timedelta(seconds=pick.randrange(0, 200_000))) for _ in range(1300)]
    rows += [("exact", T0 + timedelta(seconds=300 * i)) for i in range(6)]
    rows += [("twice", T0), ("twice", T0)]
    return rows


@pytest.mark.parametrize("small_group, slices", [(10_000, None), (1, None), (20, 6)])
def test_locks_equal_brute_force(spark, arrivals, small_group, slices):
    df = spark.createDataFrame(arrivals, "id string, ts timestamp_ntz")
    found = op.dedupe_messages(df, ttl_seconds=300, small_group=small_group, slices=slices)
    assert {tuple(row) for row in found.collect()} == brute_locks(arrivals, timedelta(seconds=300))


def test_jumps_follow_large_sessions(spark, arrivals, monkeypatch):
    calls = []
    follow = state._follow
    monkeypatch.setattr(state, "_follow", lambda *args: calls.append(1) or follow(*args))
    df = spark.createDataFrame(arrivals, "id string, ts timestamp_ntz")
    op.dedupe_messages(df, ttl_seconds=300, small_group=20).count()
    assert calls


def test_dedupe_files_reprocesses_old_versions(spark):
    rows = [("f", 1, "a"), ("f", 2, "a"), ("f", 3, "b"), ("f", 4, "a"), ("g", 5, "a"), ("g", 6, None), ("g", 7, None)]
    df = spark.createDataFrame(rows, "name string, n int, sha string")
    assert values(op.dedupe_files(df, version=["sha"], order=["n"]), "n") == [(1,), (3,), (4,), (5,), (6,)]


def test_retries_end_in_the_dead_letter_queue(spark):
    rows = [("m", n, bad) for n, bad in enumerate([True, True, False, True, True, False])]
    df = spark.createDataFrame(rows, "message_id string, n int, bad boolean").withColumn("ts", F.lit(T0))
    out = op.retry_history(df, order=["n"], failed=F.col("bad")).orderBy("n").collect()
    assert [row["outcome"] for row in out] == ["retry", "retry", "completed", "retry", "dead_letter", "dead_letter"]
    assert [row["retry_count"] for row in out] == [1, 2, 2, 3, 3, 3]
    waits = [(row["next_attempt_at"] - T0).seconds if row["next_attempt_at"] else None for row in out]
    assert waits == [1, 2, None, 4, None, None]


def test_first_failing_rule_counts(spark):
    rows = [("", None), ("a", None), ("b", b""), ("c", b"12345"), ("d", b"1234")]
    valid, rejected = op.validate_envelopes(spark.createDataFrame(rows, "id string, payload binary"), max_size=4)
    assert values(valid, "id") == [("d",)]
    assert values(rejected, "id", "reject_reason") == [
        ("", "empty_id"), ("a", "null_payload"), ("b", "empty_payload"), ("c", "payload_too_large")]


@pytest.mark.parametrize("op_name, value, expected", [
    ("=", "x", ["1"]), ("!=", "x", ["2"]), ("exists", None, ["1", "2"]), ("in", ["y", "z"], ["2"]),
    ("contains", "x", ["1"])])
def test_field_conditions(spark, op_name, value, expected):
    rows = [("1", '{"a":{"b":"x"}}'), ("2", '{"a":{"b":"y"}}'), ("3", '{"a":{}}'), ("4", "not json")]
    df = spark.createDataFrame(rows, "id string, payload string")
    assert [i for i, in values(op.filter_field(df, "$.a.b", op_name, value), "id")] == expected


def test_text_does_not_pass_a_numeric_condition(spark):
    df = spark.createDataFrame([("1", '{"n":"many"}'), ("2", '{"n":"7"}'), ("3", '{"n":8.5}')], "id string, payload string")
    assert values(op.filter_field(df, "$.n", ">", 5), "id") == [("2",), ("3",)]
    with pytest.raises(ValueError):
        op.filter_field(df, "$.n", "~", 5)


def test_undecided_rules_drop(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    assert values(op.filter_pass_drop(df, F.col("ok")), "id") == [(1,)]


def test_routing(spark):
    df = spark.range(6)
    rules = [("even", F.col("id") % 2 == 0), ("triple", F.col("id") % 3 == 0)]
    assert values(op.route(df, rules, "rest"), "id", "route") == [
        (0, "even"), (1, "rest"), (2, "even"), (3, "triple"), (4, "even"), (5, "rest")]
    assert values(op.route_many(df, rules, "rest"), "id", "route") == [
        (0, "even"), (0, "triple"), (1, "rest"), (2, "even"), (3, "triple"), (4, "even"), (5, "rest")]
    assert values(op.route(df, [], "rest").filter("id = 0"), "route") == [("rest",)]


def test_expiry_and_settling(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=1)), (3, None)], "id int, expires_at timestamp_ntz")
    assert values(op.drop_expired(df, as_of=F.lit(T0).cast("timestamp_ntz")), "id") == [(2,), (3,)]
    files = df.filter("id < 3").withColumnRenamed("expires_at", "modificationTime")
    assert values(op.drop_settling(files, as_of=F.lit(T0 + timedelta(seconds=1)).cast("timestamp_ntz")), "id") == [(1,)]


@pytest.mark.parametrize("payload, errors", [
    ('{"url":"u","n":1}', []), ('{"n":1}', ["url: required"]), ('{"url":5,"n":"x"}', ["url: not string", "n: not integer"]),
    ('[1]', ["$: not object"]), ("{", ["$: not JSON"]), ('{"url":"u","n":1.5}', ["n: not integer"]),
    ('{"url":"u","tags":"t"}', ["tags: not array"])])
def test_payload_schema(spark, payload, errors):
    schema = {"type": "object", "required": ["url"], "properties": {
        "url": {"type": "string"}, "n": {"type": "integer"}, "tags": {"type": "array"}}}
    df = spark.createDataFrame([(payload,)], "payload string")
    assert op.validate_payload(df, schema).first()["payload_errors"] == errors


def test_map_json_keeps_types_and_nesting(spark):
    df = spark.createDataFrame([("t1", '{"a":{"b":[1,{"c":true}]},"n":2.5,"s":"x"}')], "tenant_id string, payload string")
    out = op.map_json(df, {"deep": "$.a.b", "n": "$.n", "twice": {"path": "$.n", "multiply": 2}, "gone": "$.zip",
                           "fixed": {"const": 7}, "who": {"context": "tenant_id"}})
    assert bytes(out.first()["payload"]).decode() == (
        '{"deep":[1,{"c":true}],"n":2.5,"twice":5.0,"fixed":7,"who":"t1"}')


def test_csv_lines_become_messages(spark):
    df = spark.createDataFrame([("f", "a,b\r\n1,x\r\n2,y\n"), ("empty", "a,b\n"), ("none", "")], "id string, payload string")
    out = op.csv_to_json(df, "a INT, b STRING", header=True)
    fine = out.filter("conversion_error IS NULL")
    assert [(i, bytes(p).decode()) for i, p in values(fine, "id", "payload")] == [
        ("f", '{"a":1,"b":"x"}'), ("f", '{"a":2,"b":"y"}')]
    assert sorted(values(out.filter("conversion_error IS NOT NULL"), "id", "line_number", "conversion_error")) == [
        ("empty", None, "no lines"), ("none", None, "no lines")]


def test_bad_values_are_named(spark):
    df = spark.createDataFrame([('{"n":"x","t":"2024-01-02 03:04:05","b":null}',), ('{"n":"4","t":"soon","b":true}',)],
                               "payload string")
    out = op.convert_types(df, "n int, t timestamp, b boolean").select("n", "b", "conversion_errors").collect()
    assert [tuple(row) for row in out] == [(None, None, ["n"]), (4, True, ["t"])]


def test_failing_function_fails_its_message_only(spark):
    def invert(message, context):
        return {"payload": str(context["config"]["top"] / int(message["payload"]))}

    df = spark.createDataFrame([("a", b"2", 1, None), ("b", b"0", 1, None), ("c", b"x", 1, None)],
                               "id string, payload binary, payload_size bigint, last_error string")
    good, bad = op.convert_with(df, invert, config={"top": 10})
    assert [(i, bytes(p), n) for i, p, n in values(good, "id", "payload", "payload_size")] == [("a", b"5.0", 3)]
    assert [(i, e.split(":")[0]) for i, e in values(bad, "id", "last_error")] == [
        ("b", "ZeroDivisionError"), ("c", "ValueError")]
    kept = op.filter_with(df, lambda message, context: int(message["payload"]) > 1)
    assert values(kept, "id") == [("a",)]


def test_functions_see_and_keep_plain_values(spark):
    def look(message, context):
        seen = [message["n"], message["at"], message["tags"], message["note"], context["metadata"]["id"]]
        return {"payload": repr(seen), "note": "seen"}

    rows = [("a", b"", 0, None, None, ["x", "y"], None, T0), ("b", b"", 0, None, 7, None, "n", T0)]
    df = spark.createDataFrame(rows, "id string, payload binary, payload_size bigint, last_error string, n int, "
                                     "tags array<string>, note string, at timestamp_ntz")
    good, bad = op.convert_with(df, look)
    out = {row["id"]: row for row in good.collect()}
    assert bad.count() == 0 and out["a"]["n"] is None and out["b"]["n"] == 7 and out["a"]["at"] == T0
    assert out["a"]["tags"] == ["x", "y"] and out["b"]["note"] == "seen"
    assert bytes(out["a"]["payload"]).decode() == repr([None, T0, ["x", "y"], None, "a"])


def test_changes_replay_in_order(spark):
    target = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "k int, v string")
    rows = [(1, 1, "U", "uno"), (2, 2, "D", None), (3, 4, "I", "four"), (4, 4, "U", "cuatro"), (5, 5, "I", "five"),
            (6, 5, "D", None), (7, 2, "I", "dos")]
    changes = spark.createDataFrame(rows, "lsn int, k int, op string, v string")
    expected = [(1, "uno"), (2, "dos"), (3, "three"), (4, "cuatro")]
    assert values(op.apply_changes(target, changes, ["k"]), "k", "v") == expected
    again = op.apply_changes(op.apply_changes(target, changes, ["k"]), changes, ["k"])
    assert values(again, "k", "v") == expected


def test_hot_key_sends_one_row_per_task(spark):
    changes = spark.range(1000).select(F.col("id").alias("lsn"), F.when(F.col("id") > 9, 1).alias("k"), F.lit("U").alias("op"))
    plan = op.last_change(changes, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_merge_strategies(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    merged, conflicts = op.merge_rows(target, rows, ["k"], "upsert")
    assert values(merged, "k", "v") == [(1, "a"), (2, "B"), (3, "C")] and conflicts.count() == 0
    merged, conflicts = op.merge_rows(target, rows, ["k"], "insert")
    assert values(merged, "k", "v") == [(1, "a"), (2, "b"), (3, "C")] and values(conflicts, "k") == [(2,)]
    merged, conflicts = op.merge_rows(target, rows, ["k"], "update")
    assert values(merged, "k", "v") == [(1, "a"), (2, "B")] and values(conflicts, "k") == [(3,)]
    with pytest.raises(ValueError):
        op.merge_rows(target, rows, ["k"], "replace")


def test_batches_and_transactions_are_bounded(spark):
    changes = spark.range(1, 2351).select(
        F.col("id").alias("lsn"), F.when(F.col("id") % 10 == 0, "D").otherwise("U").alias("op"),
        F.when(F.col("id") <= 1500, 1).otherwise(F.col("id")).alias("txid"))
    batches = op.group_by_operation(changes, F.col("lsn").cast("string"), size=100).select(
        "op", "batch", "n_rows", F.size("rows").alias("held")).toPandas()
    assert batches["n_rows"].max() == 100 and (batches["n_rows"] == batches["held"]).all()
    assert batches["n_rows"].sum() == 2350 and (batches["op"] == "U").sum() == 22
    parts = op.group_transactions(changes, F.col("op"), max_rows=400).filter("txid = 1").orderBy("part").collect()
    assert [(p["part"], p["n_parts"], p["n_changes"], len(p["changes"])) for p in parts] == [
        (0, 4, 1500, 400), (1, 4, 1500, 400), (2, 4, 1500, 400), (3, 4, 1500, 300)]
    assert [c["lsn"] for p in parts for c in p["changes"]] == list(range(1, 1501))
    with pytest.raises(ValueError):
        op.batch_number(changes, size=1001)


def test_alert_needs_an_unbroken_hold(spark):
    load = [9, 9, 9, 1, 9, 9, 9, 9, 9, 9, None, 9, 9]
    rows = [("i", T0 + timedelta(minutes=n), v) for n, v in enumerate(load)]
    df = spark.createDataFrame(rows, "i string, ts timestamp_ntz, v int")
    out = op.sustained_alert(df, ["i"], F.col("v") > 5, hold="5 minutes").collect()
    assert [(row["started_at"], row["fired_at"], row["samples"]) for row in out] == [
        (T0 + timedelta(minutes=4), T0 + timedelta(minutes=9), 6)]


def test_capacity_and_placement(spark):
    rows = [(50, 0, 0), (49, 100_001, 0), (49, 100_000, 501), (49, 100_000, 500), (24, 0, 0), (25, 0, 0)]
    df = spark.createDataFrame(rows, "integration_count int, message_rate int, connection_count int")
    assert [row["capacity_status"] for row in op.capacity_status(df).collect()] == [
        "full_integrations", "full_rate", "full_connections", "ok", "scale_down", "ok"]
    placed = op.place_integrations(spark.range(120).select("id", F.lit("tenant-a").alias("tenant_id")))
    found = placed.groupBy("instance_name").count()
    assert values(found, "instance_name", "count") == [
        ("nats-tenant-a-1", 50), ("nats-tenant-a-2", 50), ("nats-tenant-a-3", 20)]


def test_latest_version_is_not_text_order(spark):
    df = spark.createDataFrame([("p", "1.9.0"), ("p", "1.10.0"), ("p", "2.0.0"), ("q", "1.0.0")], "name string, version string")
    assert values(op.latest_version(df, ">=1.0.0,<2.0.0"), "name", "version") == [("p", "1.10.0"), ("q", "1.0.0")]


def test_retention_keeps_the_unknown(spark):
    rows = [(1, "completed", T0), (2, "completed", None), (3, "retry", T0), (4, "completed", T0 + timedelta(days=5))]
    log = spark.createDataFrame(rows, "id int, status string, completed_at timestamp_ntz")
    as_of = F.lit(T0 + timedelta(days=5)).cast("timestamp_ntz")
    assert values(op.purge_completed(log, as_of=as_of), "id") == [(2,), (3,), (4,)]


def test_isolation_violations(spark):
    env = spark.createDataFrame([("i1", "a"), ("i1", "b"), ("i1", None), ("i2", "b")], "integration_id string, tenant_id string")
    owned = spark.createDataFrame([("i1", "a"), ("i2", "b")], "id string, tenant_id string")
    assert [tuple(r) for r in op.assert_isolated(env, owned).select("tenant_id").orderBy("tenant_id").collect()] == [
        (None,), ("b",)]


def test_duplicates_are_marked_and_no_message_is_lost(spark):
    rows = [(1, "a", 0, "x"), (2, "a", 0, "y"), (3, "a", 100, "z"), (4, "a", 300, "w"), (5, "b", 7, "v"), (6, None, 5, "u"),
            (7, None, 5, "t"), (8, "c", None, "s")]
    df = spark.createDataFrame(rows, "n long, id string, second long, body string").selectExpr(
        "n", "id", "CAST(timestamp_seconds(second) AS timestamp_ntz) AS ts", "body")
    marked = {row.n: (row.body, row.handled) for row in op.mark_duplicates(df, order=["n"], ttl_seconds=300).collect()}
    assert marked == {1: ("x", True), 2: ("y", False), 3: ("z", False), 4: ("w", True), 5: ("v", True), 6: ("u", True),
                      7: ("t", True), 8: ("s", True)}
    assert op.mark_duplicates(df.limit(0), order=["n"]).count() == 0


def test_user_functions_run_once_for_each_message(spark, tmp_path):
    def count(message, context):
        with open(tmp_path / f"{message['id']}-{os.urandom(8).hex()}", "w"):
            pass
        if message["id"] == "b":
            raise ValueError("no")
        return {"payload": "done"}

    df = spark.createDataFrame([("a", bytearray(b"1"), None), ("b", bytearray(b"2"), None)], "id string, payload binary, last_error string")
    good, bad = op.convert_with(df, count)
    assert (good.count(), bad.count(), [bytes(row.payload) for row in good.collect()]) == (1, 1, [b"done"])
    assert sorted(path.name[0] for path in tmp_path.iterdir()) == ["a", "b"]
