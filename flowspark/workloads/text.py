"""Scalar functions on whole tables."""

from pyspark.sql import functions as F

from .. import functions as fn
from . import model as m
from .registry import query


@query("content_type_of", f"WITH {m.FILES} SELECT doc_id, content_type FROM files")
def content_type_of(spark, folder):
    return m.files(spark, folder).select("doc_id", fn.content_type_of(F.col("path")).alias("content_type"))


@query("extension_of", f"WITH {m.FILES} SELECT doc_id, extension FROM files")
def extension_of(spark, folder):
    mime = F.concat(fn.content_type_of(F.col("path")), F.lit("; charset=utf-8"))
    return m.files(spark, folder).select("doc_id", fn.extension_of(mime).alias("extension"))


@query("sanitize", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
         url || html, '/', '_'), '\\', '_'), ':', '_'), '*', '_'), '?', '_'), '"', '_'), '<', '_'), '>', '_'),
         '|', '_'), chr(10), '_'), chr(13), '_') AS safe
FROM pages""")
def sanitize(spark, folder):
    pages = m.table(spark, folder, "pages")
    return pages.select("page_id", fn.sanitize(F.concat("url", "html")).alias("safe"))


@query("render_filename", f"""
WITH {m.FILES} SELECT doc_id,
  'in_' || replace(path, '/', '_') || '-' || doc_id || '-' ||
    replace(strftime(modified, '%Y-%m-%dT%H:%M:%SZ'), ':', '_') || '.' || extension AS file_name
FROM files""")
def render_filename(spark, folder):
    name = fn.render_filename(
        "in/{{.Source}}-{{.ID}}-{{.Timestamp}}.{{.Extension}}", id=F.col("doc_id").cast("string"),
        source=F.col("path"), content_type=fn.content_type_of(F.col("path")), created_at=F.col("modificationTime"))
    return m.files(spark, folder).select("doc_id", name.alias("file_name"))


@query("organize_path", f"""
WITH {m.FILES} SELECT doc_id, replace(content_type, '/', '-') AS by_type,
  strftime(modified, '%Y/%m/%d') AS by_date, replace(path, '/', '_') AS by_source, '' AS by_none
FROM files""")
def organize_path(spark, folder):
    columns = {"content_type": fn.content_type_of(F.col("path")), "source": F.col("path"),
               "created_at": F.col("modificationTime")}
    return m.files(spark, folder).select("doc_id", *[
        fn.organize_path(strategy, **columns).alias(f"by_{strategy}")
        for strategy in ("type", "date", "source", "none")])


@query("payload_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def payload_checksum(spark, folder):
    return m.files(spark, folder).select("doc_id", fn.payload_checksum(F.col("content")).alias("checksum"))


@query("file_fingerprint", f"""
WITH {m.FILES} SELECT doc_id, sha256(array_slice(encode(content), 1, 65536)) AS head_sha256,
  {m.sql_stamp("date_trunc('second', modified)")} AS mtime FROM files""")
def file_fingerprint(spark, folder):
    print_ = fn.file_fingerprint(F.col("content"), F.col("modificationTime"))
    return m.files(spark, folder).select("doc_id", print_.alias("f")).select(
        "doc_id", "f.head_sha256", m.stamp("f.mtime").alias("mtime"))


@query("client_ip", """
SELECT event_id, CASE event_id % 4
    WHEN 0 THEN '10.0.0.' || (user_id % 250) || ', 10.1.1.1'
    WHEN 1 THEN '172.16.0.' || (user_id % 250)
    WHEN 2 THEN '192.168.1.' || (user_id % 250)
    ELSE 'fe80::' || (user_id % 250) END AS client_ip
FROM events""")
def client_ip(spark, folder):
    host, kind = (F.col("user_id") % 250).cast("string"), F.col("event_id") % 4
    headers = F.create_map(
        F.lit("x-forwarded-for"), F.when(kind == 0, F.concat(F.lit("10.0.0."), host, F.lit(", 10.1.1.1 "))),
        F.lit("X-Real-Ip"), F.when(kind <= 1, F.concat(F.lit("172.16.0."), host)))
    remote = F.when(kind == 3, F.concat(F.lit("[fe80::"), host, F.lit("]:443"))).otherwise(
        F.concat(F.lit("192.168.1."), host, F.lit(":51000")))
    return m.table(spark, folder, "events").select("event_id", fn.client_ip(headers, remote).alias("client_ip"))


@query("backoff_ms", """
SELECT event_id, least(250 * (1::BIGINT << least(greatest(user_id - 1, 0), 20)), 300000)::BIGINT AS wait_ms,
  least(1000 * power(2, user_id % 12 - 1), 30000)::BIGINT AS policy_ms
FROM events""")
def backoff_ms(spark, folder):
    return m.table(spark, folder, "events").select(
        "event_id", fn.backoff_ms(F.lit(250), F.col("user_id")).alias("wait_ms"),
        fn.backoff_policy_ms(F.col("user_id") % 12).alias("policy_ms"))


@query("object_key", f"WITH {m.MESSAGES} SELECT event_id, 'temp/' || tenant_id || '/messages/' || id || '.bin' "
                     "AS object_key FROM messages")
def object_key(spark, folder):
    return m.messages(spark, folder).select(
        "event_id", fn.object_key(F.col("tenant_id"), F.col("id")).alias("object_key"))
