"""Windows that close, late rows, requests numbered over batches."""

from flowspark import streaming
from flowspark.streaming import batches


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), "tenant_id string, second long").selectExpr(
        "tenant_id", "timestamp_seconds(second) AS created_at")


def out(spark, root, number):
    try:
        rows = spark.read.parquet(f"{root}/out/batch={number}").collect()
    except Exception:
        return []
    return sorted((row.tenant_id, int(row.window_start.timestamp()), row.messages, row.per_second) for row in rows)


def test_windows_leave_once_and_state_stays_small(spark, tmp_path):
    root = str(tmp_path / "r")
    send = lambda number, *rows, **more: streaming.rate_batch(
        messages(spark, *rows), root, number, width_seconds=10, delay_seconds=5, **more)
    send(0, ("a", 1), ("a", 9), ("b", 12), (None, 3))
    assert out(spark, root, 0) == []  # nothing is five seconds past its end
    send(1, ("a", 2), ("a", 15))  # in time: the mark before was 7
    closed = {(row.tenant_id, row.messages) for row in spark.read.parquet(f"{root}/out/batch=1").collect()}
    assert closed == {("a", 3), (None, 1)}
    send(2, ("a", 4), ("b", 41))  # the first is late, the second closes all but its own window
    assert [(row.tenant_id, int(row.created_at.timestamp())) for row in spark.read.parquet(f"{root}/late").collect()] == [("a", 4)]
    assert {(row.tenant_id, row.messages) for row in spark.read.parquet(f"{root}/out/batch=2").collect()} == {("a", 1), ("b", 1)}
    assert streaming.read_batches(spark, root, "open").filter("batch = 2").count() == 1
    send(3, flush=True)
    assert out(spark, root, 3) == [("b", 40, 1, 0.1)]
    assert {path.name for path in (tmp_path / "r/open").iterdir()} <= {"batch=2", "batch=3"}


def test_a_repeated_batch_counts_once(spark, tmp_path):
    root = str(tmp_path / "r")
    for number in (0, 1, 1, 1):
        streaming.rate_batch(messages(spark, ("a", 1 + number)), root, number, width_seconds=10, delay_seconds=5)
    streaming.rate_batch(messages(spark), root, 2, width_seconds=10, delay_seconds=5, flush=True)
    assert out(spark, root, 2) == [("a", 0, 2, 0.2)]


def test_requests_are_numbered_over_batches(spark, tmp_path):
    root = str(tmp_path / "r")

    def send(number, *rows):
        df = spark.createDataFrame(list(rows), "n long, key string, second long").selectExpr("n", "key", "timestamp_seconds(second) AS ts")
        streaming.flag_batch(df, root, number, limit=2, order=["ts", "n"], delay_seconds=30)
        return sorted((row.n, row.request_number, row.over_limit) for row in spark.read.parquet(f"{root}/out/batch={number}").collect())

    assert send(0, (1, "a", 5), (2, "a", 1), (3, "b", 1)) == [(1, 2, False), (2, 1, False), (3, 1, False)]
    assert send(1, (4, "a", 50), (5, "a", 61)) == [(4, 3, True), (5, 1, False)]
    assert send(1, (4, "a", 50), (5, "a", 61)) == [(4, 3, True), (5, 1, False)]  # repeated
    assert send(2, (6, "a", 200)) == [(6, 1, False)]
    assert send(3, (7, "a", 59), (8, "a", 201)) == [(8, 2, False)]  # the first minute is over
    assert [row.n for row in spark.read.parquet(f"{root}/late").collect()] == [7]


def test_positions(tmp_path):
    root = str(tmp_path)
    assert batches.last_position(root, 5) == ({}, None)
    batches.finish(root, 3, None, {"a": 1}, ())
    assert batches.last_position(root, 5) == ({"a": 1}, 3) and batches.last_position(root, 3) == ({}, None)
    assert batches.most(None, 2, 1) == 2 and batches.most(None) is None
