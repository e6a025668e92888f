"""Class-based language model against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from flowspark import session
from flowspark.llm import classes
from flowspark.llm.classes import Bigrams, classified, coded, exchange, head_words, op12_lm_scoring, score, vocabulary

ROWS = "id long, text string, taught boolean"


def words_of(text):
    return (text or "").encode().lower().split()


def grammar(rng, n):
    """Texts of three kinds of words in turn: what class a word has shows in what stands beside it."""
    kinds = [[f"{name}{k}" for k in range(size)] for name, size in (("det", 4), ("noun", 40), ("verb", 25))]
    return [" ".join(rng.choice(kinds[j % 3]) for j in range(3 * rng.randrange(1, 12))) for _ in range(n)]


def rows_of(texts, rng):
    return [(k, text, rng.random() < 0.8) for k, text in enumerate(texts)]


def likelihood(sequences, of):
    pairs, left, right = collections.Counter(), collections.Counter(), collections.Counter()
    for words in sequences:
        kinds = ["end", *(of(word) for word in words), "end"]
        pairs.update(zip(kinds, kinds[1:]))
        left.update(kinds[:-1])
        right.update(kinds[1:])
    f = lambda counts: sum(n * math.log(n) for n in counts.values())
    return f(pairs) - f(left) - f(right)


def brute_scores(rows, of):
    """Scores by the formulas of the module from every training word's class."""
    taught = [words_of(text) for _, text, is_taught in rows if is_taught]
    counts = collections.Counter(word for words in taught for word in words)
    n, v = sum(counts.values()) + len(taught), len(counts) + 1
    kind = lambda word: of[word] if word in counts else "new"
    pairs, after, freq = collections.Counter(), collections.defaultdict(set), collections.Counter({"end": len(taught)})
    for words in taught:
        kinds = ["end", *map(kind, words), "end"]
        pairs.update(zip(kinds, kinds[1:]))
        for a, b in zip(kinds, kinds[1:]):
            after[a].add(b)
    for word, times in counts.items():
        freq[of[word]] += times
    unseen = max(1, sum(times == 1 for times in counts.values()))
    plain = lambda c: (freq[c] if c != "new" else unseen) / (n + unseen)
    step = lambda a, b: ((pairs[a, b] + len(after[a]) * plain(b)) / (freq[a] + len(after[a]))
                         if freq[a] else plain(b))
    out = {}
    for id, text, _ in rows:
        words = words_of(text)
        kinds = ["end", *map(kind, words), "end"]
        value = sum(math.log10(step(a, b)) for a, b in zip(kinds, kinds[1:]))
        value += sum(math.log10(counts[word] / freq[of[word]]) for word in words if word in counts)
        base = sum(math.log10((counts[word] + 1) / (n + v + 1)) for word in words)
        out[id] = (len(words) + 1, sum(word in counts for word in words) + 1, n,
                   base + math.log10((len(taught) + 1) / (n + v + 1)), value)
    return out, step, plain, freq, counts


def found_classes(spark, rows, k, head, rounds=3):
    df = spark.createDataFrame(rows, ROWS)
    portions = coded(df, F.col("taught"), "id", "text")
    frequent, _ = head_words(vocabulary(portions, 3), head)
    own, bigrams, seen = exchange(portions, frequent, k, rounds)
    of = dict(zip(frequent.tolist(), own.tolist()))
    told = classified(portions, frequent, own, bigrams, 3)
    for row in portions.join(told, "portion").select("words", "at", told["classes"], told["counts"].alias("n")).collect():
        for at, kind, n in zip(row.at, row["classes"], row.n):
            if n:
                assert of.setdefault(row.words[at], kind) == kind
    named = {}
    for _, text, taught in rows:
        for word in words_of(text):
            if np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64).item() in of:
                named[word] = of[np.uint64(xxhash.xxh3_64_intdigest(word)).astype(np.int64).item()]
    return named, seen, bigrams


def test_scores_agree_with_brute_force_and_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(classes, "PORTION", 300)
    monkeypatch.setattr(classes, "SLICE", 64)
    rng = random.Random(1)
    texts = grammar(rng, 150) + [None, "", " \n", "DET1 Noun2 verb3", "new words only", "noun1 " * 400, "noun1 " * 400]
    rows = rows_of(texts, rng)
    of, _, _ = found_classes(spark, rows, 5, 20)
    expected, step, plain, freq, counts = brute_scores(rows, of)
    df = spark.createDataFrame(rows, ROWS).withColumn("score", F.lit("clash"))
    for row in score(df, F.col("taught"), "id", "text", classes=5, head=20, rounds=3).collect():
        want = expected[row.id]
        assert (row.n_tokens, row.n_known, row.train_tokens) == want[:3] and row.training == rows[row.id][2]
        assert row.base_score == pytest.approx(want[3], abs=1e-7) and row.score == pytest.approx(want[4], abs=1e-7)
    kinds = {*of.values(), "end", "new"}
    for a in kinds:
        assert sum(step(a, b) for b in kinds) == pytest.approx(1)
    for kind in set(of.values()):
        assert sum(counts[word] for word in counts if of[word] == kind) == freq[kind]


def test_exchange_raises_the_likelihood_and_finds_the_kinds(spark):
    rng = random.Random(2)
    rows = [(k, text, True) for k, text in enumerate(grammar(rng, 400))]
    of, seen, bigrams = found_classes(spark, rows, 3, 60)
    assert max(seen) > seen[0] and bigrams.likelihood() == pytest.approx(max(seen))
    groups = collections.defaultdict(collections.Counter)
    for word, kind in of.items():
        groups[kind][word.rstrip(b"0123456789")] += 1
    assert sum(max(group.values()) for group in groups.values()) >= 0.95 * len(of)


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(3)
    plain = rng.integers(0, 9, (6, 6)).astype(float)
    after, before, own = rng.integers(0, 4, 6).astype(float), rng.integers(0, 4, 6).astype(float), 2.0
    start = Bigrams(plain, 4)
    after_ = []
    for number in range(4):
        other = Bigrams(plain, 4)
        other.moved(number, after, before, own, 1)
        after_.append(other.likelihood())
    gains = start.gains(after, before, own)
    assert gains - gains[0] == pytest.approx(np.array(after_) - after_[0])


def test_held_out_texts_fare_better_than_word_by_word(spark):
    rng = random.Random(4)
    rows = rows_of(grammar(rng, 500), rng)
    found = score(spark.createDataFrame(rows, ROWS), F.col("taught"), "id", "text", classes=8, head=64).filter("NOT training")
    sums = found.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert sums.score > sums.base + 0.1 * sums.n


def test_very_long_text_and_portions_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(60_000)) + " " + "x" * 100_000
    rows = [(1, text, True), (2, "w1 w2 w3", False), (None, "w4", False)]
    df = spark.createDataFrame(rows, ROWS).coalesce(1)
    whole = sorted(score(df, F.col("taught"), "id", "text", 4, 100, 2).collect(), key=str)
    monkeypatch.setattr(classes, "PORTION", 5000)
    monkeypatch.setattr(classes, "SLICE", 1000)
    cut = sorted(score(df, F.col("taught"), "id", "text", 4, 100, 2).collect(), key=str)
    for a, b in zip(whole, cut, strict=True):
        assert a[:5] == b[:5] and a.base_score == pytest.approx(b.base_score) and a.score == pytest.approx(b.score)
    assert {row.id: row.n_tokens for row in whole} == {1: 60_002, 2: 4, None: 2}


def test_groups_that_sum_counts_do_not_grow_with_the_tasks(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame(rows_of(grammar(rng, 200), rng), ROWS).repartition(16)
    portions = coded(df, F.col("taught"), "id", "text")
    frequent, _ = head_words(vocabulary(portions, 3), 30)
    alone = exchange(portions.coalesce(1), frequent, 5, 2)
    plain = classes._flat

    def few(data, name):
        assert "kind" not in data.column_names or data.num_rows <= 4
        return plain(data, name)

    monkeypatch.setattr(classes, "TASKS", 4, raising=False)
    monkeypatch.setattr(classes, "_flat", few)
    own, bigrams, seen = exchange(portions.repartition(16), frequent, 5, 2)
    assert own.tolist() == alone[0].tolist() and bigrams.counts.tolist() == alone[1].counts.tolist() and seen == alone[2]


def test_workers_get_few_portions_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(classes, "PORTION", 1000)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(500)), True) for k in range(40)]
    df = spark.createDataFrame(rows, ROWS).coalesce(1)
    files = [name.removeprefix("file:") for name in coded(df, F.col("taught"), "id", "text").inputFiles()]
    found = [pq.ParquetFile(name).metadata for name in files]
    groups = [meta.row_group(k).num_rows for meta in found for k in range(meta.num_row_groups)]
    assert sum(groups) == 20 and max(groups) <= 4

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("text"))
    with session.arrow_batches(spark, 10_000):
        assert max(row.n for row in texts.mapInArrow(sizes, "n long").collect()) <= 20
    assert spark.conf.get(key, None) == before


def test_without_rows_or_training(spark):
    assert score(spark.createDataFrame([], ROWS), F.col("taught"), "id", "text").collect() == []
    rows = score(spark.createDataFrame([(1, "a b", False), (2, None, None)], ROWS), F.col("taught"), "id", "text").collect()
    assert sorted(tuple(row) for row in rows) == [(1, False, 3, 0, 0, 0.0, 0.0), (2, False, 1, 0, 0, 0.0, 0.0)]


def test_registered_query_has_exact_base_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    held = {row.doc_id: zlib.crc32(str(row.doc_id).encode()) % 7 == 2 for row in docs}
    counts = collections.Counter(word for row in docs if not held[row.doc_id] for word in [*words_of(row.text), None])
    n, v = sum(counts.values()), len(counts)
    found = {row.doc_id: row for row in op12_lm_scoring(spark, tables).collect()}
    assert len(found) == len(docs)
    for row in docs:
        tokens, got = [*words_of(row.text), None], found[row.doc_id]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (
            held[row.doc_id], len(tokens), sum(token in counts for token in tokens), n)
        assert got.base_score == pytest.approx(sum(math.log10((counts[token] + 1) / (n + v + 1)) for token in tokens), abs=1e-6)
    assert sum(row.score for row in found.values() if row.held_out) > sum(row.base_score for row in found.values() if row.held_out)
