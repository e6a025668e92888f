"""Hard negatives against brute force and SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import negatives
from flowspark.llm.negatives import Best, Lists, mine

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, most=5):
    rows = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows]
    out = []
    for a, v, y in rows:
        if a % every:
            continue
        score = lambda w: sum(p * q for p, q in zip(v, w))  # noqa: B023,E731
        near = sorted((-score(w), b) for b, w, z in rows if z == y and b != a)[:positives]
        for s, b in near:
            window = sorted((-score(w), c) for c, w, z in rows if z != y and -80 * s <= 100 * score(w) <= -100 * s)
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(window[:most])]
    return sorted(out)


def vectors(rng, n, width, labels, coarse=False):
    pick = (lambda: rng.choice((-1.0, 0.0, 0.5, 1.0))) if coarse else (lambda: rng.gauss(0, 0.3))
    return [(k, [pick() for _ in range(width)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_mine_agrees_with_brute_force(spark, monkeypatch, coarse):
    monkeypatch.setattr(negatives, "SHARD", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = vectors(random.Random(4), 400, 3 if coarse else 8, 4, coarse)
    found = mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 9 == 0)
    assert found.columns == list(negatives.RESULT)
    assert sorted(map(tuple, found.collect())) == brute(rows, 9) != []


def test_reading_stops_early_and_misses_nothing():
    rng = np.random.default_rng(5)
    held = np.floor(rng.normal(0, 60, (4000, 3)))
    lists, anchor = Lists(np.arange(4000), held), np.array([3.0, -40.0, 0.0])
    best, seen = Best(5), 0
    for rows, scores, most in lists.read(anchor):
        best.add(scores, rows)
        seen += len(rows)
        if best.settled(most):
            break
    assert best.ids.tolist() == np.lexsort((np.arange(4000), -(held @ anchor)))[:5].tolist() and seen < 2000


def test_rows_that_take_no_part(spark):
    rows = vectors(random.Random(6), 60, 4, 2)
    odd = [(1000, None, 1), (1001, [1.0] * 4, None), (1002, [1.0, None, 1.0, 1.0], 1), (1003, [float("nan")] * 4, 0), (900, [], 1),
           (1004, [float("inf")] * 4, 1), (1005, [9.0, 9.0], 1), (None, [9.0] * 4, 1), rows[0], rows[7]]
    found = mine(spark.createDataFrame(rows + odd, ROWS).withColumn("id", F.lit("clash")), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10) != []


def test_zero_vectors_equal_scores_and_large_numbers(spark):
    rows = [(k, [0.0, 0.0], k % 2) for k in range(14)]
    found = sorted(map(tuple, mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 0).collect()))
    assert found == brute(rows, 100) and found[0] == (0, 2, 1, 1, 0, 0)
    rows = [(k, [2.0 ** 20 * (k % 5 - 2), 2.0 ** 21, 3.0], k % 2) for k in range(40)]
    assert sorted(map(tuple, mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 4 == 0).collect())) == brute(rows, 4) != []
    huge = [(k, [1e30, float(k)], k % 2) for k in range(6)]
    assert mine(spark.createDataFrame(huge, ROWS), F.col("vec_id") == 0).count() == 6


def test_few_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert mine(empty, F.col("vec_id") == 0).collect() == []
    lone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], ROWS)
    assert mine(lone, F.col("vec_id") == 0).collect() == []
    pair = spark.createDataFrame([(0, [1.0], 1), (2, [1.0], 1), (1, [1.0], 2)], ROWS)
    assert [tuple(row) for row in mine(pair, F.col("vec_id") == 0).collect()] == [(0, 2, 1, 1, 65536, 65536)]
