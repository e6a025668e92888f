"""Changes leave in LSN order, whatever order and transaction they come in."""

import pytest

from flowspark import streaming



@pytest.fixture
def log(spark, tmp_path):
    root, number = str(tmp_path / "log"), iter(range(100))

    def send(*changes, hold=10.0, opened=100.0, at=None, flush=False):
        rows = [(tx, lsn, second, last, f"r{lsn}") for tx, lsn, second, last in changes]
        df = spark.createDataFrame(rows, "txid long, lsn long, second long, is_last boolean, row string").selectExpr(
            "txid", "lsn", "timestamp_seconds(second) AS ts", "is_last", "row")
        batch = next(number) if at is None else at
        streaming.order_batch(df, root, batch, hold_seconds=hold, open_seconds=opened, flush=flush)
        try:
            found = spark.read.parquet(f"{root}/out/batch={batch}").collect()
        except Exception:
            return []
        return [(row.lsn, row.complete) for row in found]

    send.root = root
    return send


def test_interleaved_transactions_leave_in_order(log):
    assert log((1, 1, 0, False), (2, 2, 1, False), (1, 3, 2, True), hold=0) == [(1, True)]  # 2 is open: 3 must wait
    assert log((3, 5, 4, True), hold=0) == []
    assert log((2, 4, 3, True), hold=0) == [(2, True), (3, True), (4, True), (5, True)]


def test_changes_that_come_late_and_again(log, spark):
    assert log((1, 3, 30, True), (2, 5, 41, True)) == [(3, True)]  # 5 is younger than the hold
    assert log((3, 4, 31, True), (2, 5, 41, True), (4, 9, 60, True)) == [(4, True), (5, True)]  # 4 came late, 5 twice
    assert log((1, 2, 20, True), (1, 3, 30, True), hold=0) == [(9, True)]  # below the position
    late = spark.read.parquet(f"{log.root}/late")
    assert sorted((row.lsn, row.batch) for row in late.collect()) == [(2, 2), (3, 2)]


def test_a_transaction_that_never_ends_goes_out_incomplete(log):
    assert log((1, 1, 0, False), (2, 2, 1, True), hold=0, opened=50) == []
    assert log((3, 3, 60, True), hold=0, opened=50) == [(1, False), (2, True), (3, True)]


def test_a_repeated_batch_gives_the_same(log):
    log((1, 1, 0, True), (2, 2, 1, False), hold=0)
    first = log((2, 3, 2, True), (3, 4, 3, False), hold=0, at=1)
    assert log((2, 3, 2, True), (3, 4, 3, False), hold=0, at=1) == first == [(2, True), (3, True)]
    assert log((3, 5, 4, True), hold=0, at=2) == [(4, True), (5, True)]


def test_flush_and_empty_batches(log, spark):
    assert log() == [] and log((1, 7, 5, False)) == [] and log() == []
    assert streaming.flush_order(spark, log.root, batch=50)["position"] == 7
    assert [(row.lsn, row.complete, row.batch) for row in streaming.read_ordered(spark, log.root).collect()] == [(7, False, 50)]
    assert streaming.flush_order(spark, f"{log.root}-none", batch=1) == {}
