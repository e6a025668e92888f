"""Registered queries of the llm folder against their SQL, and the pipeline's stages against brute force."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from flowspark.llm import ORACLES, QUERIES, language, pieces, secrets
from flowspark.llm.common import stashed
from tests.llm.test_operators import brute_components
from tests.oracle import compare, connect


def test_operators_and_the_pipeline_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, tables, name):
    assert compare(spark, connect(tables), QUERIES[name], ORACLES[name], tables) > 0


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(extra)
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stashed(stage(spark, docs, tables), f"test-{name}")
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(docs.collect())
    start, told, joined, clean, mixed, coded = seen
    assert len(start) - len(told) <= 2 + 0.01 * len(start) and not {10**6, 10**6 + 1} & {row.doc_id for row in told}
    root = brute_components([row.text for row in sorted(told)])
    assert sorted(row.doc_id for row in joined) == [row.doc_id for k, row in enumerate(sorted(told)) if root[k][1] == k]
    assert sorted(row.doc_id for row in clean) == sorted(row.doc_id for row in joined)
    assert secrets.scan(docs.sparkSession.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long")
                        ).filter("exists(secret_spans, s -> s.kind = 'access')").count() == 0
    assert {row.doc_id for row in mixed} <= {row.doc_id for row in clean} and 0.5 < len(mixed) / len(clean) < 1.6
    texts = {row.doc_id: row.text for row in clean}
    with open(pieces.MODEL, "rb") as file:
        coder = pieces.Coder(file.read())
    assert len(coded) == len(mixed) and all(row.ids == coder.encode([texts[row.doc_id]])[0].tolist() for row in coded)
    assert language.UNKNOWN == "und"


def test_pipeline_without_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stashed(stage(spark, docs, tables), f"empty-{name}")
        assert docs.count() == 0


def test_near_copy_stage_keeps_rows_without_id_and_a_definite_copy(spark, tables):
    columns = list(corpus_pipeline.COLUMNS)
    rows = [(k, f"w{k}a{j} w{k}b{j} w{k}c{j} w{k}d{j} w{k}e{j} w{k}f{j}", "en", "s", 1) for j in (2, 0, 1) for k in range(12)]
    rows += [(None, "same text in each of these rows", "en", "s", 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.join_near_copies(spark, docs, tables)
    hashed = docs.filter("doc_id IS NOT NULL").selectExpr("*", f"xxhash64({', '.join(columns)}) AS h").collect()
    least = {k: min((row.h, row.text) for row in hashed if row.doc_id == k)[1] for k in range(12)}
    found = kept.collect()
    assert sum(row.doc_id is None for row in found) == 30 and len(found) == 42
    assert {row.doc_id: row.text for row in found if row.doc_id is not None} == least
