"""The sliced scan against plain pandas, above all with keys that hold much of the table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.operators import ordered
from flowspark.operators.ordered import exact_quantiles, ordered_scan


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows under one key, a third under NULL, the rest under small keys."""
    random = np.random.default_rng(5)
    n = 6000
    key = np.where(np.arange(n) % 3 == 0, 1.0, np.where(np.arange(n) % 3 == 1, np.nan, random.integers(2, 400, n)))
    frame = pd.DataFrame({
        "key": pd.array([None if np.isnan(k) else int(k) for k in key], dtype="Int64"),
        "at": random.permutation(n), "bad": random.random(n) < 0.3, "value": random.integers(0, 50, n)})
    return spark.createDataFrame(
        [(None if pd.isna(k) else int(k), int(a), bool(b), int(v)) for k, a, b, v in frame.itertuples(index=False)],
        "key bigint, at bigint, bad boolean, value bigint"), frame


def _expected(frame):
    frame = frame.sort_values("at").copy()
    frame["group"] = frame["key"].fillna(-1)
    groups = frame.groupby("group")
    frame["n"] = groups.cumcount() + 1
    frame["bads"] = frame["bad"].astype(int).groupby(frame["group"]).cumsum()
    frame["top"] = groups["value"].cummax()
    frame["before"] = groups["value"].shift()
    frame["total"] = groups["value"].transform("sum")
    return frame.set_index("at")[["n", "bads", "top", "before", "total"]].astype(float)


@pytest.mark.parametrize("slices", [None, 1, 2, 7, 64])
def test_scan_equals_pandas(rows, slices):
    df, frame = rows
    out = ordered_scan(
        df, ["key"], ["at"], rank="n", sums={"bads": F.col("bad").cast("int")}, maxima={"top": F.col("value")},
        previous={"before": F.col("value")}, totals={"total": F.col("value")}, slices=slices)
    found = out.toPandas().set_index("at")[["n", "bads", "top", "before", "total"]].astype(float).sort_index()
    pd.testing.assert_frame_equal(found, _expected(frame).sort_index(), check_index_type=False)


def test_only_large_keys_are_cut(rows, spark):
    df, _ = rows
    plan = ordered_scan(df, ["key"], ["at"], rank="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "__slice" in plan
    small = df.filter(F.col("key") > 1)
    assert "__slice" not in ordered_scan(small, ["key"], ["at"], rank="n")._jdf.queryExecution().optimizedPlan().toString()


def test_no_task_gets_a_whole_large_key(rows, spark):
    df, _ = rows
    large, position = ordered.find_slicing(df, ["key"], "at")
    pieces = df.filter(large).groupBy("key", position.alias("slice")).count().toPandas()
    assert pieces["count"].max() <= 2 * 2000 / 8
    assert len(pieces) == 16


def test_thin_sample_is_not_used(rows, monkeypatch):
    df, frame = rows
    monkeypatch.setattr(ordered, "SAMPLE_BYTES", 10)
    assert ordered.find_slicing(df, ["key"], "at") is not None
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    out = ordered_scan(df, ["key"], ["at"], rank="n").toPandas().set_index("at")["n"].astype(float).sort_index()
    pd.testing.assert_series_equal(out, _expected(frame)["n"].sort_index(), check_index_type=False)


def test_whole_table_as_one_key(rows):
    df, frame = rows
    out = ordered_scan(df, [], ["at"], rank="n").toPandas()
    assert (out["n"] == out["at"] + 1).all()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double", "int"])
def test_order_by_times_and_numbers(spark, kind):
    base = spark.range(2000).select((F.col("id") * 86400).alias("s"))
    moment = F.timestamp_seconds("s").cast(kind) if kind in ("timestamp", "timestamp_ntz", "date") else F.col("s").cast(kind)
    out = ordered_scan(base.select("s", moment.alias("m")), [], ["m"], rank="n", slices=9).toPandas()
    assert (out["n"] == out["s"] // 86400 + 1).all()


@pytest.mark.parametrize("prefix", ["", "order-", "é/"])
def test_order_by_text(spark, prefix):
    texts = sorted({prefix + str((n * 7919) % 5000) + "xyz"[: n % 4] for n in range(900)} | {prefix})
    df = spark.createDataFrame([(text,) for text in texts], "name string")
    out = ordered_scan(df, [], ["name"], rank="n", slices=9)
    assert [row["name"] for row in out.orderBy("n").collect()] == texts
    slicing = ordered.find_slicing(df, [], "name", 9)
    assert df.select(slicing.position.alias("s")).distinct().count() > 5


def test_text_outside_the_sampled_prefix(spark):
    sampled = spark.range(100).select(F.concat(F.lit("m-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"))
    more = sampled.union(spark.createDataFrame([("a",), ("m",), ("z",), ("",), (None,)], "name string"))
    out = ordered_scan(more, [], ["name"], rank="n", slices=6, sample_from=sampled).orderBy("n").collect()
    assert [row["name"] for row in out] == [None] + sorted(["a", "m", "z", ""] + [f"m-{n:03d}" for n in range(100)])


def test_order_by_a_struct_is_refused(spark):
    with pytest.raises(TypeError):
        ordered_scan(spark.range(3).select(F.struct("id").alias("s")), [], ["s"], rank="n")


def test_empty_input(spark):
    assert ordered_scan(spark.range(0), [], ["id"], rank="n").count() == 0


@pytest.mark.parametrize("slices", [None, 5])
def test_quantiles_are_nearest_rank(rows, slices):
    df, frame = rows
    found = exact_quantiles(df, ["key"], "value", [0.0, 0.5, 0.99, 1.0], slices).toPandas()
    found["key"] = found["key"].fillna(-1)
    for group, values in frame.assign(key=frame["key"].fillna(-1)).groupby("key")["value"]:
        ordered_values = np.sort(values)
        for p in (0.0, 0.5, 0.99, 1.0):
            expected = ordered_values[max(int(np.ceil(p * len(values))), 1) - 1]
            hit = found[(found["key"] == group) & (found["probability"] == p)]["value"]
            assert list(hit) == [expected]
