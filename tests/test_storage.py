"""Files, stores, deliveries, tables and connectors in temporary folders."""

import json
import os
import pathlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark import plans, sinks, sources
from flowspark.operators import files_to_envelopes, new_envelope
from flowspark.sinks.storage import open_store, put
from flowspark.sources.files import read_objects
from flowspark.sources.records import jdbc_options
from flowspark.sources.registry import known_types, open_source, register_source, send_to

def at():
    return F.lit(datetime(2024, 3, 1, 10, 20, 30)).cast("timestamp")


def envelopes(spark, rows):
    df = spark.createDataFrame(rows, "id string, payload binary, content_type string, source string, tenant_id string")
    return new_envelope(df, created_at=at())


def tree(root):
    root = pathlib.Path(root)
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()
                  and not any(part.startswith(("_", ".")) for part in p.relative_to(root).parts))


def test_folder_is_listed_without_subfolders(spark, tmp_path):
    for name in ("file1.json", "file2.json", "file3.txt", "sub/file4.json", "day=1/file5.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"key":"value"}')
    files = sources.read_files(spark, str(tmp_path), "*.json")
    assert sorted(os.path.basename(row["path"]) for row in files.collect()) == ["file1.json", "file2.json"]
    env = files_to_envelopes(files).first()
    assert (env["source"], env["content_type"], env["payload_size"]) == ("FileConsumer", "application/json", 15)
    assert env["expires_at"] - env["created_at"] == timedelta(minutes=15) and len(env["id"]) == 36


def test_content_is_not_read_where_not_asked_for(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = sources.read_files(spark, str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_files_are_written_where_planned(spark, tmp_path):
    env = envelopes(spark, [
        ("a", b"one", "application/json", "s", "t"), ("b", b"two", "text/csv", "s", "t"), ("", b"x", "", "s", "t"),
        ("c", b"", "", "s", "t"), ("d/../../e", b"safe", "text/plain", "s", "t"), ("f", b"12345678", "", "s", "t")])
    plan = sinks.plan_file_output(env, organize_by="type", max_size=7)
    report = sinks.write_files(plan, str(tmp_path))
    assert tree(tmp_path) == ["application-json/a.json", "text-csv/b.csv", "text-plain/d_.._.._e.txt"]
    assert (tmp_path / "text-csv/b.csv").read_bytes() == b"two"
    assert report.count() == 3
    reasons = {row["id"]: row["reject_reason"] for row in plan.collect()}
    assert reasons[""] == "empty_id" and reasons["c"] == "empty_payload" and reasons["f"] == "payload_too_large"
    sinks.write_files(plan, str(tmp_path))
    assert len(tree(tmp_path)) == 3


@pytest.mark.parametrize("name", [".", ".."])
def test_paths_stay_below_the_root(spark, name):
    env = envelopes(spark, [(name, b"x", "", "..", "t")])
    assert sinks.plan_file_output(env, "{{.ID}}").first()["reject_reason"] == "path_traversal"
    assert sinks.plan_file_output(env, "x", organize_by="source").first()["reject_reason"] == "path_traversal"


def test_newest_message_of_a_path_is_kept(spark, tmp_path):
    from flowspark.sinks.files import latest_per_path
    env = envelopes(spark, [("a", b"old", "", "s", "t"), ("b", b"new", "", "s", "t")])
    plan = latest_per_path(sinks.plan_file_output(env, "{{.Source}}.txt"))
    sinks.write_files(plan, str(tmp_path))
    assert tree(tmp_path) == ["s.txt"] and (tmp_path / "s.txt").read_bytes() == b"new"


def test_files_are_settled(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("good.txt", "bad_file.txt"):
        (inbox / name).write_text("x")
    listed = sources.read_files(spark, str(inbox)).withColumn(
        "error", F.when(F.contains("path", F.lit("bad")), "permission denied"))
    kwargs = dict(as_of=at(), archive_dir=str(tmp_path / "archive"), error_dir=str(tmp_path / "error"))
    report = sinks.settle_files(listed, report_dir=str(tmp_path / "_r1"), **kwargs)
    assert sorted(row["action"] for row in report.collect()) == ["archived", "error"]
    assert tree(tmp_path) == ["archive/2024-03-01/good.txt", "error/2024-03-01/bad_file.txt",
                              "error/2024-03-01/bad_file.txt.error"]
    note = (tmp_path / "error/2024-03-01/bad_file.txt.error").read_text()
    assert note == "timestamp=2024-03-01T10:20:30Z\nerror=permission denied\n"


@pytest.mark.parametrize("delete, left", [(True, []), (False, ["a.txt"])])
def test_files_are_deleted_or_left(spark, tmp_path, delete, left):
    (tmp_path / "a.txt").write_text("x")
    listed = sources.read_files(spark, str(tmp_path)).withColumn("error", F.lit(None).cast("string"))
    sinks.settle_files(listed, as_of=at(), delete=delete, report_dir=str(tmp_path / "_report"))
    assert tree(tmp_path) == left


def test_large_payloads_travel_by_reference(spark, tmp_path):
    env = envelopes(spark, [("small", b"x" * 10, "", "s", "t1"), ("large", b"y" * 11, "", "s", "t1")])
    store = str(tmp_path / "store")
    light = sinks.offload_payloads(env, store, threshold=10)
    rows = {row["id"]: row for row in light.collect()}
    assert rows["small"]["payload_ref"] is None and rows["large"]["payload"] is None
    assert rows["large"]["payload_ref"] == f"{store}/t1/messages/large.bin" and rows["large"]["payload_size"] == 11
    assert tree(store) == ["t1/messages/large.bin"]
    full = {row["id"]: row for row in sinks.resolve_payload_refs(light, store).collect()}
    assert bytes(full["large"]["payload"]) == b"y" * 11 and full["large"]["payload_ref"] is None
    lost = light.withColumn("payload_ref", F.when(F.col("id") == "large", F.lit(f"{store}/t1/messages/gone.bin")))
    assert {row["id"]: row["payload_ref"] for row in sinks.resolve_payload_refs(lost, store).collect()}["large"]
    (tmp_path / "secret.bin").write_bytes(b"s")
    for reference in (f"{store}/../secret.bin", f"{tmp_path}/secret.bin"):
        stolen = light.withColumn("payload_ref", F.lit(reference)).filter(F.col("id") == "large")
        assert sinks.resolve_payload_refs(stolen, store).first()["payload"] is None


def test_fetched_payloads_come_in_bounded_batches(spark, tmp_path):
    env = envelopes(spark, [(str(n), bytes([n]) * 100, "", "s", "t") for n in range(20)]).coalesce(1)
    light = sinks.offload_payloads(env, str(tmp_path), threshold=10)
    full = sinks.resolve_payload_refs(light, str(tmp_path), batch_bytes=250)
    assert {row["id"]: bytes(row["payload"]) for row in full.collect()} == {str(n): bytes([n]) * 100 for n in range(20)}


def test_objects_have_keys_below_the_root(spark, tmp_path):
    store, root = open_store(f"file://{tmp_path}/s")
    put(store, f"{root}/a/s/b.bin", b"1")
    assert [row["key"] for row in read_objects(spark, f"{tmp_path}/s").select("key").collect()] == ["a/s/b.bin"]


def test_delivery_tries_and_waits(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def send(body, headers):
        with open(log / headers["X-Message-ID"], "a") as out:
            out.write(json.dumps({"body": body.decode(), **headers}) + "\n")
        tries = len((log / headers["X-Message-ID"]).read_text().splitlines())
        return {"ok": 204, "late": 200 if tries == 3 else 500, "never": 404}[headers["X-Message-ID"]]

    def wait(seconds):
        with open(log / "waits", "a") as out:
            out.write(f"{seconds}\n")

    env = envelopes(spark, [("ok", b"a", "application/json", "s", "t"), ("late", b"b", "", "s", "t"),
                            ("never", b"c", "", "s", "t")])
    report = sinks.deliver(env, send, str(tmp_path / "report"), headers={"X-Key": "k"}, wait=wait)
    found = {row["id"]: (row["attempts"], row["status"], row["delivered"], row["error"]) for row in report.collect()}
    assert found == {"ok": (1, 204, True, None), "late": (3, 200, True, None), "never": (3, 404, False, "status 404")}
    assert sorted((log / "waits").read_text().split()) == ["1.0", "1.0", "2.0", "2.0"]
    first = json.loads((log / "ok").read_text())
    assert first == {"body": "a", "Content-Type": "application/json", "X-Key": "k", "X-Message-ID": "ok"}
    assert json.loads((log / "late").read_text().splitlines()[0])["Content-Type"] == "text/plain"
    report.count()
    assert len((log / "ok").read_text().splitlines()) == 1


def test_no_try_is_no_success(spark, tmp_path):
    env = envelopes(spark, [("a", b"x", "", "s", "t")])
    row = sinks.deliver(env, lambda body, headers: 200, str(tmp_path / "r"), attempts=0).first()
    assert not row["delivered"] and row["attempts"] == 0


def test_whole_envelope_can_be_sent(spark, tmp_path):
    def send(body, headers):
        return 200 if json.loads(body)["id"] == "a" and headers["Content-Type"] == "application/json" else 400

    env = envelopes(spark, [("a", b"x", "text/csv", "s", "t")])
    assert sinks.deliver(env, send, str(tmp_path / "r"), attempts=1, body="envelope").first()["delivered"]


def test_bus_round_trip(spark, tmp_path):
    env = envelopes(spark, [("a", b"x", "text/csv", "s", "t1")])
    send_to(env, "nats", {"path": str(tmp_path), "subject": "order.new", "stage": "converted"})
    back = open_source(spark, "nats", {"path": str(tmp_path), "topic": "order.>"}).first()
    assert (back["id"], bytes(back["payload"]), back["tenant_id"]) == ("a", b"x", "t1")
    assert back["step_history"] == ["nats-input:order.new.converted"] and back["payload_size"] == 1


def test_table_is_written_beside_the_old_one(spark, tmp_path):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "k int, v string")
    new = sinks.write_table(target, rows, ["k"], str(tmp_path / "v2"))
    assert sorted(tuple(row) for row in new.collect()) == [(1, "A"), (2, "B")]
    for strategy in ("insert", "update"):
        with pytest.raises(sinks.tables.WriteConflict):
            sinks.write_table(target, rows, ["k"], str(tmp_path / "v3"), strategy=strategy)
    assert not (tmp_path / "v3").exists()


def test_bad_csv_lines_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\noops,y\n")
    rows = sources.read_csv_records(spark, str(tmp_path), "a int, b string", bad_record="bad").cache()
    assert sorted((row["a"] or 0, row["bad"]) for row in rows.collect()) == [(0, "oops,y"), (1, None)]


def test_jdbc_reads_are_split():
    options = jdbc_options("jdbc:x", "orders", column="id", lower=0, upper=100, partitions=4, user="u")
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id" and options["user"] == "u"
    assert "numPartitions" not in jdbc_options("jdbc:x", "orders")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "orders", column="id")


def test_database_writes_are_batched():
    assert sinks.tables.jdbc_write_options("jdbc:x", "t")["batchsize"] == "100"
    for size in (0, 1001):
        with pytest.raises(ValueError):
            sinks.tables.jdbc_write_options("jdbc:x", "t", batch_size=size)


def test_old_days_are_dropped(spark, tmp_path):
    days = spark.createDataFrame([("2024-01-29",), ("2024-01-31",), ("2024-02-29",)], "d string")
    sinks.write_archive(days, str(tmp_path), processed_at=F.col("d").cast("timestamp"))
    assert sinks.drop_expired_days(str(tmp_path), as_of=datetime(2024, 3, 1).date(), days=30) == ["2024-01-29"]
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_unknown_types_are_refused(spark):
    with pytest.raises(ValueError, match="unknown source type: ftp"):
        open_source(spark, "ftp", {})
    with pytest.raises(ValueError, match="unknown sink type: ftp"):
        send_to(spark.range(1), "ftp", {})
    with pytest.raises(ValueError, match="missing option: path"):
        open_source(spark, "file", {})
    assert {"file", "http", "nats"} <= set(known_types()["sources"]) & set(known_types()["sinks"])


def test_python_data_source_class_is_a_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Numbers(DataSource):
        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from ((n,) for n in range(3))
            return Reader()

    register_source("numbers", Numbers)
    assert open_source(spark, "numbers", {}).count() == 3


def test_config_from_settings():
    good = {"INPUT_TYPE": "file", "INPUT_CONFIG": '{"path":"/in"}', "OUTPUT_TYPE": "nats",
            "OUTPUT_CONFIG": '{"path":"/out","subject":"s"}'}
    config = plans.load_config(good)
    assert config["source"] == {"type": "file", "options": {"path": "/in"}} and config["sinks"]["out"]["type"] == "nats"
    for name in good:
        with pytest.raises(ValueError, match=f"{name} is required"):
            plans.load_config({**good, name: ""})
    with pytest.raises(ValueError, match="INPUT_CONFIG is not valid JSON"):
        plans.load_config({**good, "INPUT_CONFIG": "{"})


def test_flow_from_files_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(4):
        (tmp_path / f"in/o{n}.json").write_text(json.dumps({"n": n, "kind": "a" if n % 2 else "b"}))
    (tmp_path / "in/bad.json").write_text('["not an order", {"n": 5}]')
    config = plans.load_config({
        "INPUT_TYPE": "file", "INPUT_CONFIG": json.dumps({"path": str(tmp_path / "in"), "pattern": "*.json"}),
        "OUTPUT_TYPE": "file", "OUTPUT_CONFIG": json.dumps({"path": str(tmp_path / "out")})})
    config["steps"] = [{"kind": "validate"}, {"kind": "validate_payload", "schema": {"type": "object"}},
                       {"kind": "filter", "path": "$.n", "op": ">", "value": 0},
                       {"kind": "map_json", "mapping": {"n": "$.n"}}]
    report = plans.run_flow(spark, config, stage_dir=str(tmp_path / "stage"))
    assert {row["route"]: row["messages"] for row in report.collect()} == {"out": 3, "dropped": 1, "rejected": 1}
    bodies = sorted(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert bodies == ['{"n":1}', '{"n":2}', '{"n":3}']


def test_flow_refuses_unknown_steps(spark):
    with pytest.raises(ValueError, match="unknown step: fold"):
        plans.Flow([{"kind": "fold"}]).annotate(spark.range(1))
