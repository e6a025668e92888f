"""Literal cases of names, types, addresses, waits and versions."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowspark import functions as fn
from flowspark.schema import ENVELOPE


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, expected", [
    ("file.json", "application/json"), ("file.txt", "text/plain"), ("file.csv", "text/csv"),
    ("file.xml", "application/xml"), ("file.yaml", "application/yaml"), ("file.yml", "application/yaml"),
    ("file.unknown", "application/octet-stream"), ("noextension", "application/octet-stream"),
    ("/dir.json/plain", "application/octet-stream"), ("archive.tar.zip", "application/zip"),
    ("FILE.JSON", "application/octet-stream"), ("page.html", "text/html"), (".json", "application/json")])
def test_content_type(spark, name, expected):
    assert value(spark, fn.content_type_of(F.lit(name))) == expected


def test_system_types_do_not_replace_fixed_ones(spark):
    extra = {".png": "image/png", ".json": "text/odd"}
    assert value(spark, fn.content_type_of(F.lit("a.png"), extra)) == "image/png"
    assert value(spark, fn.content_type_of(F.lit("a.svg"))) == "image/svg+xml"
    assert value(spark, fn.content_type_of(F.lit("a.nothing"))) == "application/octet-stream"
    assert value(spark, fn.content_type_of(F.lit("a.json"), extra)) == "application/json"


@pytest.mark.parametrize("mime, expected", [
    ("application/json", "json"), ("text/plain", "txt"), ("text/csv", "csv"), ("application/xml", "xml"),
    ("application/yaml", "yaml"), ("text/yaml", "yaml"), ("application/octet-stream", "bin"), ("unknown/type", "bin"),
    ("application/json; charset=utf-8", "json"), ("", "bin"), (None, "bin")])
def test_extension(spark, mime, expected):
    assert value(spark, fn.extension_of(F.lit(mime).cast("string"))) == expected


def test_sanitize(spark):
    assert value(spark, fn.sanitize(F.lit('a/b\\c:d*e?f"g<h>i|j\nk\rl\0m n.o'))) == "a_b_c_d_e_f_g_h_i_j_k_l_m n.o"


@pytest.mark.parametrize("template, mime, expected", [
    ("{{.ID}}.{{.Extension}}", "application/json", "k 7.json"),
    ("{{.ID}}_{{.ID}}.{{.Extension}}", "text/plain", "k 7_k 7.txt"),
    ("day{{.ID}}.{{.Extension}}", "text/csv", "dayk 7.csv"),
    ("{{ .Source }}/{{.Timestamp}}", "text/csv", "a_b_2024-03-01T10_20_30Z"),
    ("{{.Missing}}", "text/csv", "_no value_"), ("fixed", "", "fixed"), ("", "", None)])
def test_filename(spark, template, mime, expected):
    name = fn.render_filename(template, id=F.lit("k 7"), source=F.lit("a:b"), content_type=F.lit(mime),
                              created_at=F.lit("2024-03-01 10:20:30.9").cast("timestamp_ntz"))
    assert value(spark, name) == expected


@pytest.mark.parametrize("strategy, enabled, expected", [
    ("type", True, "application-json"), ("date", True, "2024/03/01"), ("source", True, "a_b"), ("none", True, ""),
    ("type", False, ""), ("odd", True, "")])
def test_organize(spark, strategy, enabled, expected):
    path = fn.organize_path(strategy, enabled=enabled, content_type=F.lit("application/json"), source=F.lit("a/b"),
                            created_at=F.lit("2024-03-01 10:20:30").cast("timestamp_ntz"))
    assert value(spark, path) == expected


def test_organize_without_value(spark):
    for strategy in ("type", "source"):
        path = fn.organize_path(strategy, content_type=F.lit(""), source=F.lit(None).cast("string"))
        assert value(spark, path) == "unknown"


@pytest.mark.parametrize("headers, remote, expected", [
    ({"X-Forwarded-For": "1.1.1.1, 2.2.2.2 "}, "9.9.9.9:1", "1.1.1.1, 2.2.2.2"),
    ({"x-real-ip": "3.3.3.3"}, "9.9.9.9:1", "3.3.3.3"),
    ({"X-Forwarded-For": "", "X-Real-IP": "3.3.3.3"}, "9.9.9.9:1", "3.3.3.3"),
    ({}, "9.9.9.9:1", "9.9.9.9"), ({}, "[::1]:80", "::1"), ({}, "9.9.9.9", ""), ({}, "::1", "")])
def test_client_ip(spark, headers, remote, expected):
    df = spark.createDataFrame([(headers, remote)], "h map<string,string>, r string")
    assert df.select(fn.client_ip(F.col("h"), F.col("r"))).first()[0] == expected


@pytest.mark.parametrize("base, attempts, expected", [
    (100, 1, 100), (100, 2, 200), (100, 3, 400), (1000, 0, 1000), (1000, 9, 256_000), (1000, 10, 300_000),
    (1000, 100, 300_000), (0, 5, 0), (-1, 5, 0), (2 ** 62, 50, 300_000)])
def test_backoff(spark, base, attempts, expected):
    assert value(spark, fn.backoff_ms(F.lit(base), F.lit(attempts))) == expected


def test_backoff_policy(spark):
    waits = [value(spark, fn.backoff_policy_ms(F.lit(n))) for n in (1, 2, 3, 6, 60)]
    assert waits == [1000, 2000, 4000, 30_000, 30_000]


@pytest.mark.parametrize("pattern, subject, expected", [
    ("a.*.c", "a.b.c", True), ("a.*.c", "a.b.b.c", False), ("a.>", "a.b.c", True), ("a.>", "a", False),
    ("a.b", "a.b", True), ("a.b", "axb", False), (">", "x.y", True), ("*", "x.y", False)])
def test_subject(spark, pattern, subject, expected):
    assert value(spark, fn.match_subject(F.lit(subject), pattern)) is expected


def test_subject_tail_must_be_last():
    with pytest.raises(ValueError):
        fn.subject_regex("a.>.b")


@pytest.mark.parametrize("pattern, path, expected", [
    ("*.json", "/in/a.json", True), ("*.json", "/in/a.jsonx", False), ("a?.txt", "ab.txt", True),
    ("[a-c]*", "/x/bee", True), ("[^a-c]*", "/x/bee", False), ("\\*.txt", "*.txt", True), ("\\*.txt", "a.txt", False),
    ("*", "/x/y", True), ("[[]x", "[x", True), ("a.b", "aXb", False)])
def test_glob(spark, pattern, path, expected):
    assert value(spark, fn.match_glob(F.lit(path), pattern)) is expected


def test_bad_glob():
    with pytest.raises(ValueError):
        fn.glob_regex("[a")


@pytest.mark.parametrize("version, allowed, expected", [
    ("1.10.0", ">=1.2.0,<2.0.0", True), ("2.0.0", ">=1.2.0,<2.0.0", False), ("1.1.9", ">=1.2.0", False),
    ("1.4.2", "1.%", True), ("v1.4.2", "=1.4.2", True), ("1.4.2", "1.4.2", True)])
def test_version_range(spark, version, allowed, expected):
    assert value(spark, fn.in_range(F.lit(version), allowed)) is expected


def test_bad_version_range():
    with pytest.raises(ValueError):
        fn.in_range(F.lit("1.0.0"), "newest")


def test_fingerprint_reads_the_head_only(spark):
    body = b"x" * 65536
    at = F.lit("2024-01-01 00:00:00.7").cast("timestamp_ntz")
    one = value(spark, fn.file_fingerprint(F.lit(body + b"1"), at))
    two = value(spark, fn.file_fingerprint(F.lit(body + b"2"), at))
    assert one == two and one["mtime"].microsecond == 0


ROUND_TRIP = "id tenant_id integration_id payload payload_size content_type step_history retry_count".split()


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(
    st.text(min_size=1, max_size=20).filter(lambda s: "\ud800" > max(s) or max(s) > "\udfff"),
    st.binary(min_size=1, max_size=300), st.lists(st.text("abc:é", max_size=5), max_size=3),
    st.integers(0, 10)), min_size=1, max_size=8))
def test_envelope_round_trip(spark, rows):
    from datetime import datetime, timezone
    at = datetime(2024, 1, 2, 3, 4, 5, 678900, tzinfo=timezone.utc)
    data = [(i, "tenant-456", "integration-789", p, None, len(p), "text/plain", "s", 1, h, at, at, r, None)
            for i, p, h, r in rows]
    df = spark.createDataFrame(data, ENVELOPE)
    back = df.select(fn.envelope_from_json(fn.envelope_to_json()).alias("e")).select("e.*")
    assert [row.asDict() for row in back.collect()] == [row.asDict() for row in df.collect()]


def test_envelope_json_leaves_out_empty_fields(spark):
    df = spark.createDataFrame([("a", b"", None, None)], "id string, payload binary, payload_ref string, last_error string")
    from flowspark.operators import new_envelope
    env = new_envelope(df, created_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    text = env.select(fn.envelope_to_json()).first()[0]
    assert '"payload"' not in text and "payload_ref" not in text and "last_error" not in text
    assert '"step_history":[]' in text and '"created_at":"2024-01-01T00:00:00Z"' in text


def test_large_payload_survives(spark):
    body = bytes((i // 1024) % 256 for i in range(5 * 1024 * 1024))
    df = spark.createDataFrame([("big", body)], "id string, payload binary")
    from flowspark.operators import new_envelope
    env = new_envelope(df, created_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    back = env.select(fn.envelope_from_json(fn.envelope_to_json())["payload"].alias("p")).first()["p"]
    assert bytes(back) == body
