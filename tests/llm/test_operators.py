"""Operators of the llm folder against brute force on small inputs, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import chat, jaccard, language, licences, mixing, neighbours, pieces, quality, repeats, secrets
from flowspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=""):
    rows = [(k, text, "en", f"s{k % 3}", len(text or "")) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


# --- n-gram Jaccard join

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets, root = [shingles(text) for text in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = sentence(rng, 1)
    return " ".join(words)


def test_jaccard_agrees_with_brute_force(spark):
    rng = random.Random(5)
    line = sentence(rng, 12)
    texts = [None, "", " \n\t", "One", "one", "one two three", "ONE two  three", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = sentence(rng, 60)
        texts += [base, base, base.upper()] + [edited(rng, base, rng.randint(1, 4)) for _ in range(12)]
        texts += [line + "\n" + edited(rng, base, 1), base + " " + line]
    base = sentence(rng, 80)
    for _ in range(15):  # a chain: each text is like its neighbours only
        texts.append(base)
        base = edited(rng, base, 2)
    texts += [line] * 3 + [line + " " + sentence(rng, 2) for _ in range(8)]
    found = {row.doc_id: (row.n_shingles, row.component_id) for row in jaccard.link(documents(spark, texts)).collect()}
    assert found == brute_components(texts)


def test_jaccard_without_rows_or_ids(spark):
    assert jaccard.link(documents(spark, [])).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS component_id", "3 AS tokens")
    found = sorted((tuple(row) for row in jaccard.link(df).collect()), key=str)
    assert found == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, None, None)], key=str)


def test_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(50, 60), (60, 50), (61, 50), (70, 70)]
    found = {row.node: row.root for row in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 10 for k in range(10, 41)}, 50: 50, 60: 50, 61: 50}


# --- repeated substrings

def brute_cut(texts, length):
    data = [(text or "").encode() for text in texts]
    starts = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        marks = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if starts[d[k:k + length]] > 1:
                marks[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if marks[k] and not (k and marks[k - 1]))
        out.append((len(d), sum(marks), spans, bytes(b for b, m in zip(d, marks) if not m)))
    return out


@pytest.mark.parametrize("length, gram", [(40, 25), (16, 4), (9, 9)])
def test_repeats_agree_with_brute_force(spark, length, gram):
    rng = random.Random(length)
    passages = [sentence(rng, 30, "abé日 ") for _ in range(4)]
    texts = [None, "", "short", "ab" * 60, "x" * 100]
    for _ in range(40):
        parts = [sentence(rng, rng.randint(1, 25)), rng.choice(passages), sentence(rng, rng.randint(1, 25))]
        texts.append(edited(rng, " ".join(parts), rng.randint(0, 3)))
    texts += [passages[0], passages[0], passages[1] + passages[2] + passages[1]]
    df = documents(spark, texts).selectExpr("*", "1 AS doc", "2 AS kept", "3 AS first")
    found = {row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept))
             for row in repeats.without_repeats(df, length=length, gram=gram).collect()}
    assert [found[k] for k in range(len(texts))] == brute_cut(texts, length)


def test_repeats_of_rows_and_of_none(spark):
    assert repeats.without_repeats(documents(spark, [])).count() == 0
    long = sentence(random.Random(1), 200)
    df = spark.createDataFrame([(1, long), (1, long), (None, "é" * 150)], "doc_id long, text string")
    rows = [(row.doc_id, row.n_bytes, row.n_removed) for row in repeats.without_repeats(df, length=100, gram=60).collect()]
    assert sorted(rows, key=str) == sorted([(1, len(long), len(long)), (1, len(long), len(long)), (None, 300, 300)], key=str)


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    from flowspark.llm import anchors
    monkeypatch.setattr(repeats, "PLACES", 10)
    monkeypatch.setattr(repeats, "AT_ONCE", 300)
    rng = random.Random(3)
    piece = sentence(rng, 60)
    texts = [sentence(rng, 400) + piece + sentence(rng, 300), piece + sentence(rng, 500)]
    sizes = [len(t) for t in texts]
    parts = list(repeats._buffers(texts, 40))
    windows = {0: set(), 1: set()}
    for rows, pieces_, places in parts:
        for row, data, at in zip(rows, pieces_, places):
            windows[row] |= set(range(at, at + len(data) - 39))
    assert [windows[k] == set(range(sizes[k] - 39)) for k in (0, 1)] == [True, True]
    assert anchors.PLACES >= 20


# --- secrets

def brute_secrets(text):
    text, found = text or "", []
    for order, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        if rule.kind == "access":
            pattern, least, group = r"AKIA[A-Z0-9]+", 20, 0
        elif rule.kind == "hex":
            pattern, least, group = r"[0-9a-f]+", 24, 0
        else:
            least, group = rule.least, rule.group
        found += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(pattern, text, re.ASCII)
                  if len(m[group]) >= least]
    return sorted(found)


def test_secrets_agree_with_regular_expressions(spark):
    texts = [None, "", "password: token: abcdefgh", "日本 PassWord = 'abcDEF12' x secret=abc api_key:\"zzzzzzzz\"",
             "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 20, "f" * 24 + " " + "0" * 23 + "g" + "1" * 30,
             "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab", "AIza" + "x" * 35,
             "sk_live_" + "Z" * 20, "eyJabcdefghij.eyJabcdefghij.abcdefghijk", "see https://me:pw@host/x", "token=short secret=longenough",
             "é" * 50 + "apikey=1234567"]
    rng = random.Random(2)
    parts = ["password", "=", " ", ":", "token", "'", "abcdef", "AKIA", "0" * 12, "SECRET", "\n", "é", "api", "_", "key", "A1" * 9]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = documents(spark, texts + texts[:3]).selectExpr("*", "1 AS secret_spans", "2 AS may_match", "3 AS `row`")
    for row in secrets.scan(df).collect():
        assert [tuple(span) for span in row.secret_spans] == brute_secrets(row.text), row.text
    assert secrets.scan(documents(spark, [])).count() == 0


def test_trigram_queries_follow_from_patterns():
    assert secrets.trigram_query("[0-9a-f]{24,}") == ()
    assert secrets.trigram_query("AKIA[A-Z]+") == ((frozenset({"aki", "kia"}),),)
    assert secrets.trigram_query("(abcd|xyz)+q") == ((frozenset({"abc", "bcd"}), frozenset({"xyz"})),)
    assert secrets.trigram_query("a?b*cd") == ()


def test_redaction(spark):
    text = "x password=abcdef1 y AKIA" + "A" * 16 + "."
    df = secrets.redacted(secrets.scan(documents(spark, [text, None, "clean"]).select("doc_id", "text")))
    assert [row.text for row in df.orderBy("doc_id").collect()] == ["x [assign] y [access].", None, "clean"]


# --- language

def test_kneser_ney_probabilities_sum_to_one():
    keys, _ = language._grams(["the cat sat on the mat", "a cat"])
    other, _ = language._grams(["der hund sass auf der matte", "ein hund"])
    models = language.fit({"en": np.unique(keys, return_counts=True), "de": np.unique(other, return_counts=True)})
    letters = [0] + sorted({ord(c) for c in "the cat sat on the mat a cat der hund sass auf der matte ein hund" if c != " "})
    for context in ("", "t", "th", "ca", "xyz", "der"):
        base = 0
        for c in context[-3:]:
            base = base << 16 | ord(c)
        probe = np.array([(base << 16 | c) & ((1 << 64) - 1) for c in letters], np.uint64)
        total = np.exp(models.score(probe).astype(float)).sum(axis=0) + np.exp(models.score(
            np.array([(base << 16 | 0x3042) & ((1 << 64) - 1)], np.uint64)).astype(float))[0]
        assert np.allclose(total, 1, atol=1e-4), (context, total)


def test_languages_are_told_apart(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = language.op4_language_id(spark, tables).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(found) > 20 and sum(row.lang == row.lang_pred for row in found) >= 0.95 * len(found)
    assert all(0 <= row.score <= 1 for row in found)


def test_language_edge_cases(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(
        [("the cat is here and there", "en"), ("le chat est ici et la", "fr"), (None, "en"), ("", "fr"), ("12 34 !", "en"),
         ("the dog", None), ("the cat is here and there", "en")] * 3)] + [(None, "the cat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS gram")
    found = language.identify(df, language.train(df)).collect()
    assert len(found) == len(rows)
    for row in found:
        if not re.search("[a-z]", row.text or ""):
            assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
        else:
            assert row.lang_pred == ("fr" if "chat" in row.text else "en")
    assert {row.lang_pred for row in language.identify(df, language.train(df.limit(0))).collect()} == {"und"}
    assert language.identify(df.limit(0), language.train(df)).count() == 0


def test_long_texts_score_like_their_pieces(monkeypatch):
    text = sentence(random.Random(4), 500)
    whole, _ = language._grams([text])
    monkeypatch.setattr(language, "PIECE", 100)
    cut = np.concatenate([language._grams([piece])[0] for piece in language._cut(text)])
    assert "".join(language._cut(text)) == text
    assert np.array_equal(whole[whole != 0], cut[cut != 0])


def test_models_keep_rare_grams_and_equal_the_models_in_memory(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARD_BYTES", 2000)
    monkeypatch.setattr(language, "CACHE_BYTES", 6000)
    rare = ["zebra quagga okapi", "zebra gnu", "ibex the cat"]
    common = spark.range(6).selectExpr("'en' AS lang", "repeat('the cat ', 60000) AS text")
    other = [("de", text) for text in ("der hund sass auf der matte", "ein hund", "die katze lag auf dem sofa")]
    models = language.train(common.unionByName(spark.createDataFrame([("en", x) for x in rare] + other, "lang string, text string")))
    keys = {"en": [*["the cat " * 60_000] * 6, *rare], "de": [text for _, text in other]}
    grams = {name: language._grams(texts)[0] for name, texts in keys.items()}
    memory = language.fit({name: np.unique(own, return_counts=True) for name, own in grams.items()})
    probe = np.unique(np.concatenate([*grams.values(), language._grams(["zebu hundert xyz katzen"])[0]]))
    assert models.languages == memory.languages and max(part.shards for part in models.grams) > 1
    assert np.allclose(models.score(probe), memory.score(probe), atol=1e-5)
    asked = spark.createDataFrame([(k, text) for k, text in enumerate(rare)], "doc_id long, text string")
    assert {row.lang_pred for row in language.identify(asked, models).collect()} == {"en"}


# --- quality

def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k:k + 8])].append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics_agree_with_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n \n\t", "a", "é # $\n\na\na\n", "x y " * 30, "\x0b\x0cz\r\n"]
    for _ in range(60):
        part = sentence(rng, rng.randint(1, 14), "ab#é")
        texts.append("\n".join(rng.choice([part, sentence(rng, 5, "ab"), "", " "]) for _ in range(rng.randint(1, 8))))
    for row in quality.statistics(documents(spark, texts), keep=("doc_id",)).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute_statistics(
            texts[row.doc_id]), texts[row.doc_id]


def test_decision_lists_learn_what_separates(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + (" ###" * 15 if k % 4 == 0 else "") for k in range(400)]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    found = {row.doc_id: row.kept for row in quality.judge(df, labels).collect()}
    assert found == {k: k % 4 != 0 for k in range(400)}
    base = quality.judge(df, labels.limit(0)).collect()
    assert all(row.kept == (not row.base_failed) for row in base)
    assert quality.judge(df.limit(0), labels).count() == 0


# --- pieces

def test_pieces_agree_with_sentencepiece(spark):
    import sentencepiece
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    parts = ["a", "the", "  ", " ", "\n", "\t", "é", "日", "🎉", "\u0000", "▁", "<s>", "<unk>", "<0x0A>", "1234", "     ", "ation"]
    texts = ["", " ", "\n", None] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    df = documents(spark, texts).selectExpr("*", "1 AS ids", "2 AS decoded")
    found = pieces.decode(pieces.encode(df, pieces.read_model(spark), round_trip="same"), pieces.read_model(spark)).collect()
    assert len(found) == len(texts)
    for row in found:
        if row.text is None:
            assert (row.ids, row.decoded, row.same) == (None, None, True)
            continue
        ids = theirs.encode(row.text)
        assert row.ids == ids and row.decoded == theirs.decode(ids) and row.same == (row.decoded == row.text)
    assert pieces.encode(df.limit(0), pieces.read_model(spark)).count() == 0


def test_whole_texts_give_the_same_ids_as_units():
    with open(pieces.MODEL, "rb") as file:
        coder = pieces.Coder(file.read())
    whole = pieces.tokenizer(coder.model)
    texts = ["The thing  and\n\nthe ring ", "▁x ▁", "a" * 3000]
    assert coder.cuts and [row.tolist() for row in coder.encode(texts)] == [
        found.ids for found in whole.encode_batch(texts, add_special_tokens=False)]


def test_unigram_models(tmp_path):
    def field(number, kind, data):
        return bytes([number << 3 | kind]) + data

    import struct
    made = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("abc", -1.5, 1), ("c", -2.0, 1)]
    data = b""
    for text, score, kind in made:
        piece = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        data += field(1, 2, bytes([len(piece)]) + piece)
    data += field(2, 2, b"\x02" + field(3, 0, b"\x01"))
    coder = pieces.Coder(data)
    assert coder.model.kind == pieces.UNIGRAM and not coder.cuts
    assert [coder.model.pieces[k][0] for k in coder.encode(["ab abc"])[0]] == ["▁ab", "▁ab", "c"]
    assert coder.decode(coder.encode(["ab abc"])[0]) == "ab abc"


# --- chats

def test_chats_agree_with_brute_force(spark):
    rng = random.Random(6)
    rows, logs = [], {}
    for k in range(60):
        turns = [(rng.choice(["user", None]), rng.choice(["hi", "", None, "x<|y"])) for _ in range(rng.randint(1, 5))]
        logs[k] = turns
        rows += [(k, n * 700 - 1, *turn) for n, turn in enumerate(turns)]
    rows += [(None, 1, "user", "lone"), (None, 2, "user", "row")]
    logs[None] = [("user", "lone"), ("user", "row")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS h1", "2 AS block")
    kept = [a for a, x in logs.items() if not any(
        y[:len(x)] == x and (len(y) > len(x) or b is None or a is not None and b < a) for b, y in logs.items() if a != b)]
    found = collections.defaultdict(list)
    for row in chat.format_chats(df).collect():
        assert row.n_turns == len(logs[row.conv_id])
        found[row.conv_id].append((row.position, row.rendered))
    assert set(found) == set(kept)
    for k in kept:
        assert [text for _, text in sorted(found[k])] == [
            f"<|{role or ''}|>\n{(text or '').replace('<|', '< |')}\n<|end|>\n" for role, text in logs[k]]
    assert chat.format_chats(df.limit(0)).count() == 0


# --- mixing

def test_counts_follow_the_poisson_distribution(spark):
    rows = [(k, f"t{k}", None if k % 2 else "b") for k in range(20000)] + [(0, "t0", "b"), (None, "n", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS copy", "2 AS rate", "3 AS sums")
    out = mixing.mix(df, weights={"b": 1.0}, otherwise=3.0, total=24000.0)
    counts = collections.Counter((row.source, row.doc_id) for row in out.collect())
    by = {source: [counts[(source, k)] for k in range(20000) if (k % 2 == 1) == (source is None)] for source in ("b", None)}
    assert abs(np.mean(by["b"]) - 0.6) < 0.03 and abs(np.mean(by[None]) - 1.8) < 0.04
    zero = sum(n == 0 for n in by["b"]) / len(by["b"])
    assert abs(zero - math.exp(-0.6)) < 0.02 and counts[("b", 0)] % 2 == 0
    again = mixing.mix(df, weights={"b": 1.0}, otherwise=3.0, total=24000.0)
    assert collections.Counter((row.source, row.doc_id) for row in again.collect()) == counts
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, weights={}).count() == 0
    order = [row.mix_order for row in out.collect()]
    assert len(set(order)) > 0.99 * len(order) and abs(np.mean(order) - 0.5) < 0.01
    assert order == sorted(order)  # read in order, the partitions are one global shuffle


def test_counts_of_rates_above_one_invert_the_whole_distribution(spark):
    def inverse(rate, u):
        k, log, total = 0, -rate, math.exp(-rate)
        while total <= u:
            k += 1
            log += math.log(rate) - math.log(k)
            total += math.exp(log)
        return k

    sizes, wanted = {"a": 3000, "b": 2000, "c": 500, "d": 3}, {"a": 1.8, "b": 1.0, "c": 2000.0, "d": 0.0}
    rows = [(k, f"{s}{k}", s) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {s: wanted[s] * sizes[s] for s in sizes}
    out = mixing.mix(df, weights=weights, total=sum(weights.values())).groupBy("source", "doc_id").count().collect()
    counts = {(row.source, row.doc_id): row["count"] for row in out}
    drawn = {row.doc_id: row.u for row in df.filter("source = 'a'").select(
        "doc_id", mixing.uniform(f"{mixing.SEED}/count", df.doc_id).alias("u")).collect()}
    assert all(counts.get((s, k), 0) == inverse(wanted[s], drawn[k]) for s in "abc" for k in range(sizes[s]))
    zero = sum(("a", k) not in counts for k in range(3000)) / 3000
    assert abs(zero - math.exp(-1.8)) < 0.03 and not any(s == "d" for s, _ in counts)


# --- neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 24))
    vectors[10] = vectors[20] = vectors[30]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] + [1.0] * 23), (1004, [None] + [1.0] * 23),
             (1005, [1.0] * 3), (None, [1.0] * 24), (1006, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS shard", "3 AS score")
    asks = df.vec_id % 10 == 0
    found = collections.defaultdict(list)
    for row in neighbours.nearest(df, asks, radius=10).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.vec_id, row.score))
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    hits = 0
    assert set(found) == set(range(0, 900, 10))
    for q, got in found.items():
        score = units @ units[q]
        score[q] = -2
        assert len(got) == 5 and all(abs(score[k] - s) < 1e-12 for k, s in got)
        hits += len({k for k, _ in got} & set(np.lexsort((np.arange(900), -score))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found)
    assert [k for k, _ in found[10][:2]] == [20, 30]
    few = df.filter("vec_id < 3")
    assert sorted((row.query_id, row.vec_id) for row in neighbours.nearest(few, few.vec_id == 0).collect()) == [(0, 1), (0, 2)]
    assert neighbours.nearest(df.limit(0), asks).count() == 0


def test_radius_search_finds_every_code():
    rng = np.random.default_rng(4)
    units = neighbours._units(rng.normal(size=(3000, 22)))
    index = neighbours.Index(units, np.linalg.qr(rng.normal(size=(22, 22)))[0])
    bits = units @ index.rotation >= 0
    for q in range(5):
        distance = (bits != bits[q]).sum(axis=1)
        for radius in (0, 1, 3, 4, 7, 22):
            assert set(index.within(units[q], radius).tolist()) == set(np.flatnonzero(distance <= radius).tolist())


# --- licences

def test_licences(spark):
    rng = random.Random(12)
    texts = ["Plain text here\n" + template + "\nmore" for group in licences.TEMPLATES.values() for template in group]
    texts += [None, "", "\n\n", "the licence plate of the car", "mit"] + [sentence(rng, 40, "abcdefghij") for _ in range(200)]
    df = documents(spark, texts).selectExpr("*", "1 AS words", "2 AS features", "3 AS p")
    found = {(row.doc_id, row.paragraph): (row.family, row.confirmed) for row in licences.find(df).collect() if row.confirmed}
    families = [family for family, group in licences.TEMPLATES.items() for _ in group]
    assert found == {(k, 1): (family, True) for k, family in enumerate(families)}
    assert licences.find(df.limit(0)).count() == 0


def test_wrapped_and_commented_notices_are_paragraphs(spark):
    long = [(family, text) for family, group in licences.TEMPLATES.items() for text in group if len(text) > 100]
    texts = []
    for mark in ("", "# ", " * ", "// "):
        for _, text in long:
            texts.append("Plain words here\n\n" + "\n".join(mark + line for line in textwrap.wrap(text, 70)) + f"\n{mark}\nmore")
    rng = random.Random(13)
    texts += [sentence(rng, 40, "abcdefghij") for _ in range(200)] + ["\r\n\r\n", None]
    found = {(row.doc_id, row.family, row.paragraph) for row in licences.find(documents(spark, texts)).collect()
             if row.confirmed}
    assert len(long) >= 4 and found == {(k, family, 2) for k, (family, _) in enumerate(long * 4)}


HELD_OUT = ("The code may be used under the {}.", "This library is covered by the {}; see the file LICENSE.", "Published under {} terms.",
            "Copyright 2024 The Team. Use is governed by the {}.")
REWORDED = {
    "mit": "Permission is granted free of charge to any person who obtains a copy of this software to deal in it without restriction, "
           "including the rights to use, copy, modify, merge, publish and sell copies.",
    "bsd": "Redistribution in source and binary forms, with or without modification, is permitted if these conditions are met: source "
           "code must retain the copyright notice and this list of conditions.",
    "gpl": "You may redistribute this program and modify it under the terms of the GNU General Public License of the Free Software "
           "Foundation, version 2 or any later version.",
    "apache": "You may not use these files except in compliance with the Apache License, Version 2.0; a copy is at apache.org/licenses.",
    "cc-by-sa": "The text is available under the Creative Commons Attribution-ShareAlike License, version 4.0 International.",
    "public-domain": "The author released this work into the public domain; anyone is free to copy, modify and sell it for any purpose."}


def test_held_out_wordings_of_licences(spark):
    """Precision and recall per family on wordings that training has not seen; other paragraphs are left alone."""
    cases = [(family, frame.format(name)) for family, names in licences.NAMES.items() for name in names for frame in HELD_OUT]
    cases += list(REWORDED.items())
    assert not {text for _, text in cases} & {text for text, _, _ in licences._variants(sorted(licences.TEMPLATES))}
    rng = random.Random(21)
    plain = [sentence(rng, 30, "abcdefghij") for _ in range(300)]
    plain += ["The general public was not amused by the software.", "All the conditions of the weather were met without notice.",
              "He had permission to use the copy room free of charge.", "The foundation published its terms of work."]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licences.find(documents(spark, [text for _, text in cases] + plain), trained=licences.train(corpus)).collect()
    found = {row.doc_id: row.family for row in rows}
    assert not [k for k in found if k >= len(cases)]
    for family in REWORDED.keys() | {"cc-by", "mpl"}:
        told = [k for k in found if found[k] == family]
        own = [k for k, (name, _) in enumerate(cases) if name == family]
        precision, recall = len(set(told) & set(own)) / len(told), len(set(told) & set(own)) / len(own)
        assert precision >= 0.85 and recall >= 0.75, (family, precision, recall)


def test_licences_learn_from_all_paragraphs(spark):
    """One paragraph a document, more than any sample had: all of them are training rows."""
    corpus = spark.range(25_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the road of the "), F.col("id").cast("string")).alias("text"))
    model, limits = licences.train(corpus)
    learned = model.summary.predictions.filter("weight < 25")
    assert learned.count() == 25_000
    assert learned.agg(F.sum("weight")).first()[0] == pytest.approx(licences.OTHERS)
    assert limits == [licences.LEAST] * len(licences.TEMPLATES)


def test_licence_shares_are_those_of_the_templates(spark):
    rng = random.Random(22)
    texts = [template for group in licences.TEMPLATES.values() for template in group]
    texts += [" ".join(word for word in text.split() if rng.random() < 0.85) for text in texts]
    cut = lambda text: re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    for row in licences.find(documents(spark, texts)).collect():
        own = set(cut(texts[row.doc_id]))
        share = max(len(own & set(cut(template))) / len(set(cut(template))) for template in licences.TEMPLATES[row.family])
        assert row.share == pytest.approx(share) and row.confirmed == (share >= licences.SHARE)


def test_very_long_texts_and_odd_rows_of_licences(spark):
    notice = licences.TEMPLATES["gpl"][2]
    long = "\n".join(f"line {k} of a long text" for k in range(60_000)) + f"\n\n{notice}\n\n" + "word " * 200_000
    df = documents(spark, [long, None, "", notice, notice]).unionByName(documents(spark, []))
    found = sorted((row.doc_id, row.paragraph, row.family) for row in licences.find(df).collect() if row.confirmed)
    assert found == [(0, 60_001, "gpl"), (3, 0, "gpl"), (4, 0, "gpl")]


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_foreign_and_senseless_texts_are_rejected(spark):
    taught = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(~language.held_out(F.col("doc_id")))
    texts = ["Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
             "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
             "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
             "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.", "жизнь человека прекрасна",
             "xkqz vwprt zzkl qqjx bvcm wrtp lkjh", "qwxzj kvbqz wxqjz pzkvq"]
    models = language.train(taught)
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    assert all(row.rejected for row in language.identify(df, models).collect())
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(language.held_out(F.col("doc_id")))
    assert language.identify(held.filter("lang IS NOT NULL AND text IS NOT NULL"), models).filter("rejected").count() <= 1


@pytest.mark.parametrize("partitions", ["2", "40"])
def test_unlike_short_texts_are_never_linked(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        words = spark.range(150_000).selectExpr("id AS doc_id", "concat('w', hex(id * 7919)) AS text")
        copies = spark.range(4).selectExpr("id + 1000000 AS doc_id", "concat('Same ', 'text') AS text")
        found = jaccard.link(words.unionByName(copies)).filter("component_id <> doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((row.doc_id, row.component_id) for row in found) == [(10**6 + k, 10**6) for k in (1, 2, 3)]


def test_sets_of_few_shingles_are_told_apart_by_their_words(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "sets", lambda texts: ((k, np.array([5], np.uint64)) for k in range(len(texts))))
    found = jaccard.link(documents(spark, ["one", "two", "one", "two words", "a a a a a a", "a a a a a a a a"])).collect()
    assert [row.component_id for row in sorted(found)] == [0, 1, 0, 3, 4, 4]


def test_components_that_share_many_shingles_without_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROSSING", 0)  # rounds of hubs until these join nothing
    rng = random.Random(9)
    shared = sentence(rng, 30)
    texts = [f"{shared} {sentence(rng, 25)}" for _ in range(40)]
    texts += [edited(rng, text, 1) for text in texts[:20]]
    found = jaccard.link(documents(spark, texts)).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in found} == brute_components(texts)
