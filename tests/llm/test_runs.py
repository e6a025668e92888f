"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from flowspark.llm.runs import LEAST, TIMES, find_runs, lyndon, op11_periodic_runs, runs


def brute_lyndon(words):
    ends = []
    for i in range(len(words)):
        j = i + 1
        while j < len(words) and words[j:] > words[i:]:
            j += 1
        ends.append(j - i)
    return ends


def brute_runs(words):
    found = set()
    for q in range(1, len(words) // TIMES + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(LEAST, TIMES * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.add((i, len(part), q))
            i = j + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    return " ".join(word for k, word in enumerate(words) if k not in gone)


def some_words(rng, number):
    words = [rng.choice("abc"[:1 + number % 3]) for _ in range(rng.randrange(60))]
    if number % 3 == 0:
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        words = words[:8] + unit * rng.randrange(2, 8) + unit[:rng.randrange(len(unit))] + words[8:16]
    return words


def test_lyndon_words_and_runs_agree_with_brute_force():
    rng = random.Random(1)
    for number in range(400):
        words = [ord(word) for word in some_words(rng, number)]
        assert lyndon(words) == brute_lyndon(words)
        assert runs(np.array(words, np.int64), np.zeros(len(words), int)) == brute_runs(words)


def test_runs_of_several_texts_stay_apart():
    words = [1, 2] * 3 + [1, 2] * 2 + [1, 2] * 4
    text = [0] * 6 + [1] * 4 + [2] * 8
    assert runs(np.array(words), np.array(text)) == [(10, 8, 2)]


def test_hashes_that_agree_by_chance_change_nothing(monkeypatch):
    from flowspark.llm import runs as module
    monkeypatch.setattr(module, "mixed", lambda values: np.ones_like(values))
    words = [5, 5, 5, 5, 5, 5, 5, 1, 2, 1, 2, 1, 2, 1, 2, 9]
    assert set(module.runs(np.array(words), np.zeros(len(words), int))) <= set(brute_runs(words))


def test_find_runs(spark):
    rng = random.Random(2)
    texts = [" ".join(some_words(rng, k)) for k in range(200)]
    texts += [None, "", " \t\n", "x", "a " * 6, "a\tb\n" * 4, "é ü " * 9, "same " * 50, "same " * 50]
    df = spark.createDataFrame([(k % 190, text, "clash") for k, text in enumerate(texts)], "id long, text string, runs string")
    rows = find_runs(df).collect()
    assert len(rows) == len(texts)
    expected = []
    for k, text in enumerate(texts):
        words = [word.decode() for word in (text or "").encode().split()]
        found = brute_runs(words)
        expected.append((k % 190, text or "", len(words), [list(run) for run in found], collapsed(words, found)))
    assert sorted((row.id, row.text or "", row.n_words, row.runs, row.collapsed) for row in rows) == sorted(expected)


def test_very_long_texts(spark):
    rng = random.Random(3)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    words = [f"v{k}" for k in range(150_000)] + unit * 400 + ["end"]
    row = find_runs(spark.createDataFrame([(1, " ".join(words))], "id long, text string")).first()
    assert row.runs == [[150_000, 280_000, 700]] and row.collapsed.split() == words[:150_700] + ["end"]


def test_no_rows(spark):
    assert find_runs(spark.createDataFrame([], "text string")).count() == 0


def test_registered_query(spark, tables, tmp_path):
    given = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    rows = [(row.doc_id, row.text) for row in given] + [(10**9 + k, None if k % 2 else "a b c " * k) for k in range(60)] + [(None, "x " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(row.doc_id, row.runs_sha256, row.collapsed_sha256): row for row in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) >= 200
    for doc, text in rows:
        words = [word.decode() for word in (text or "").encode().split()]
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs_ = brute_runs(words) if n < 2500 else [tuple(x) for x in runs(
            np.unique(np.array(words), return_inverse=True)[1], np.zeros(n, int))]
        digest = lambda value: hashlib.sha256(value.encode()).hexdigest()
        row = found[doc, digest("".join(f"{s},{ln},{q}\n" for s, ln, q in runs_)), digest(collapsed(words, runs_))]
        best = min(runs_, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)
        assert row.n_runs == len(runs_)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
