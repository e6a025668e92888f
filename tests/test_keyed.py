"""Keyed tables in buckets: what a write touches, versions side by side, conflicts, replicas."""

import pathlib

import pytest
from pyspark.sql import functions as F

from flowspark import sinks
from flowspark.operators import merge_rows
from flowspark.sinks import keyed
from flowspark.sinks.tables import WriteConflict

ROWS = "k long, name string, v double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)) for p in pathlib.Path(path, "data").rglob("*.parquet")}


def table(spark, path, n=2000, buckets=64):
    keyed.create_keyed(str(path), ROWS, ["k"], buckets=buckets)
    df = spark.range(n).selectExpr("id AS k", "concat('n', id) AS name", "CAST(id AS double) AS v")
    return keyed.write_keyed(df, str(path), strategy="insert")


def test_a_write_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    first, touched = table(spark, tmp_path)
    assert sorted(touched) == list(range(64)) and first.version == 1
    before = files(tmp_path)
    few = rows(spark, *[(k, "new", -1.0) for k in range(0, 2000, 100)])  # one key in a hundred
    second, touched = keyed.write_keyed(few, str(tmp_path))
    made = files(tmp_path) - before
    buckets = {row[0] for row in few.select(keyed.bucket_of(["k"], 64)).distinct().collect()}
    assert set(touched) == buckets and len(buckets) <= 20
    assert {name.rsplit("/", 1)[0] for name in made} == {f"data/write=2/bucket={bucket}" for bucket in buckets}
    assert before <= files(tmp_path)  # no file of another bucket was written again or removed
    old, new = keyed.read_keyed(spark, str(tmp_path), first.version), keyed.read_keyed(spark, str(tmp_path))
    assert old.filter("name = 'new'").count() == 0 and new.filter("name = 'new'").count() == 20
    assert old.count() == new.count() == 2000
    assert sorted(row.k for row in old.join(new, ["k", "name", "v"], "left_anti").collect()) == list(range(0, 2000, 100))


def test_strategies_and_conflicts(spark, tmp_path):
    table(spark, tmp_path, 10, 4)
    path = str(tmp_path)
    with pytest.raises(WriteConflict, match="insert"):
        keyed.write_keyed(rows(spark, (3, "x", 0.0), (11, "y", 0.0)), path, strategy="insert")
    with pytest.raises(WriteConflict, match="update"):
        keyed.write_keyed(rows(spark, (11, "y", 0.0)), path, strategy="update")
    with pytest.raises(WriteConflict, match="upsert"):
        keyed.write_keyed(rows(spark, (None, "y", 0.0)), path)
    with pytest.raises(WriteConflict, match="upsert"):
        keyed.write_keyed(rows(spark, (1, "y", 0.0), (1, "z", 0.0)), path)
    assert keyed.versions(path) == [0, 1]  # nothing was published
    keyed.write_keyed(rows(spark, (3, "x", 0.0), (11, "y", 0.5), (None, "n", 1.0), (5, "a", 0.0), (5, "b", 0.0)), path,
                      strategy="insert", on_conflict="skip")
    found = {row.k: row.name for row in keyed.read_keyed(spark, path).collect()}
    assert found == {**{k: f"n{k}" for k in range(10)}, 11: "y"}
    assert keyed.write_keyed(rows(spark), path)[1] == [] and keyed.read_keyed(spark, path).count() == 11


def test_one_writer_at_a_time_and_lost_writes(spark, tmp_path, monkeypatch):
    first, _ = table(spark, tmp_path, 20, 4)
    path = str(tmp_path)
    stray = tmp_path / "data/write=2/bucket=0"
    stray.mkdir(parents=True)
    (stray / "part-0.parquet").write_bytes(b"a write that was lost")
    keyed.write_keyed(rows(spark, *[(k, "again", 0.0) for k in range(20)]), path)
    assert keyed.read_keyed(spark, path).filter("name = 'again'").count() == 20
    monkeypatch.setattr(keyed, "manifest", lambda path, version=None: first)  # a writer that read version 1
    with pytest.raises(keyed.ConcurrentWrite):
        keyed.write_keyed(rows(spark, (1, "late", 0.0)), path)


def test_vacuum_keeps_what_the_newest_versions_hold(spark, tmp_path):
    table(spark, tmp_path, 100, 8)
    path = str(tmp_path)
    keyed.write_keyed(rows(spark, (1, "one", 0.0)), path)
    keyed.write_keyed(rows(spark, (1, "two", 0.0)), path)
    expected = content(keyed.read_keyed(spark, path))
    assert keyed.vacuum(path) == [0, 1, 2] and keyed.versions(path) == [3]
    assert content(keyed.read_keyed(spark, path)) == expected
    assert not (tmp_path / "data/write=2").exists() and len(list((tmp_path / "data/write=1").glob("bucket=*"))) == 7
    with pytest.raises(FileNotFoundError):
        keyed.read_keyed(spark, path, 1)


def test_replica_bears_repeats_late_changes_and_deletions(spark, tmp_path):
    path = str(tmp_path)
    sinks.create_replica(path, "k long, v string", ["k"], buckets=8)
    sinks.load_replica(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string"), path)
    change = lambda *values: spark.createDataFrame(list(values), "lsn long, op string, k long, v string")
    batches = [change((5, "U", 1, "a5"), (6, "D", 2, None)), change((3, "U", 2, "late"), (7, "I", 4, "d")),
               change((7, "I", 4, "d"), (8, "D", 4, None), (9, "I", 2, "back"), (10, "U", None, "no key"))]
    for number, batch in enumerate(batches):
        sinks.apply_to_replica(batch, path, number)
        assert sinks.apply_to_replica(batch, path, number)[1] == []  # done already
    assert content(sinks.read_replica_table(spark, path)) == [(1, "a5"), (2, "back"), (3, "c")]
    assert content(sinks.read_replica_table(spark, path, 2)) == [(1, "a5"), (3, "c")]
    assert keyed.manifest(path).batch == 2


def test_rows_without_key_meet_in_no_task(spark):
    target = rows(spark, (1, "a", 0.0))
    incoming = spark.range(20000).selectExpr("CAST(NULL AS long) AS k", "'n' AS name", "CAST(id AS double) AS v").unionByName(
        rows(spark, (2, "b", 0.0)))
    merged, conflicts = merge_rows(target, incoming, ["k"])
    assert content(merged) == [(1, "a", 0.0), (2, "b", 0.0)] and conflicts.count() == 20000
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()


def test_composite_keys_and_bad_tables(spark, tmp_path):
    keyed.create_keyed(str(tmp_path / "a"), ROWS, ["k", "name"], buckets=3)
    keyed.write_keyed(rows(spark, (1, "a", 0.0), (1, "b", 0.0)), str(tmp_path / "a"))
    keyed.write_keyed(rows(spark, (1, "b", 9.0)), str(tmp_path / "a"))
    assert content(keyed.read_keyed(spark, str(tmp_path / "a"))) == [(1, "a", 0.0), (1, "b", 9.0)]
    for keys, buckets in (([], 3), (["x"], 3), (["k"], 0)):
        with pytest.raises(ValueError):
            keyed.create_keyed(str(tmp_path / "b"), ROWS, keys, buckets=buckets)
    with pytest.raises(keyed.ConcurrentWrite):
        keyed.create_keyed(str(tmp_path / "a"), ROWS, ["k"])
    assert keyed.read_keyed(spark, str(tmp_path / "a"), 0).count() == 0
