"""Envelopes: making, encoding, landing, merging."""

from pyspark.sql import functions as F

from .. import operators as op
from ..functions import envelope_from_json, envelope_to_json, unpacked
from ..schema import ENVELOPE_COLUMNS
from ..sinks import to_bus_records
from . import model as m
from .registry import query

ENVELOPE_JSON = """
'{"id":"' || id || '","tenant_id":"' || tenant_id || '","integration_id":"' || integration_id ||
'","payload":"' || base64(encode(payload)) || '","payload_size":' || payload_size ||
',"content_type":"application/json","source":"' || source || '","current_step":0,"step_history":[],"created_at":"' ||
regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z","expires_at":"' ||
regexp_replace(strftime(expires_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z","retry_count":0}'"""


@query("new_envelope", f"""
WITH {m.MESSAGES} SELECT id, tenant_id, integration_id, payload_size, source, 0 AS current_step, 0 AS retry_count,
  0 AS history_size, {m.sql_stamp('created_at')} AS created_at, {m.sql_stamp('expires_at')} AS expires_at
FROM messages""")
def new_envelope(spark, folder):
    return m.messages(spark, folder).select(
        "id", "tenant_id", "integration_id", "payload_size", "source", "current_step", "retry_count",
        F.size("step_history").alias("history_size"), m.stamp("created_at").alias("created_at"),
        m.stamp("expires_at").alias("expires_at"))


@query("envelope_to_json", f"WITH {m.MESSAGES} SELECT id, {ENVELOPE_JSON} AS body FROM messages")
def to_json(spark, folder):
    return m.messages(spark, folder).select("id", envelope_to_json().alias("body"))


@query("envelope_from_json", f"""
WITH {m.MESSAGES} SELECT id, tenant_id, integration_id, payload, payload_size, source,
  {m.sql_stamp('created_at')} AS created_at, {m.sql_stamp('expires_at')} AS expires_at FROM messages""")
def from_json(spark, folder):
    decoded = m.messages(spark, folder).select(unpacked(envelope_from_json(envelope_to_json()), ENVELOPE_COLUMNS))
    return decoded.select(
        "id", "tenant_id", "integration_id", F.col("payload").cast("string").alias("payload"), "payload_size",
        "source", m.stamp("created_at").alias("created_at"), m.stamp("expires_at").alias("expires_at"))


@query("append_step", f"""
WITH {m.MESSAGES} SELECT id, 2 AS current_step, 'received:' || source || '>converted' AS path FROM messages""")
def append_step(spark, folder):
    env = op.append_step(m.messages(spark, folder), F.concat(F.lit("received:"), "source"))
    return op.append_step(env, "converted").select(
        "id", "current_step", F.array_join("step_history", ">").alias("path"))


@query("files_to_envelopes", f"""
WITH {m.FILES} SELECT 'file-' || doc_id AS id, 'FileConsumer' AS source, length AS payload_size, content_type,
  sha256(content) AS checksum, {m.sql_stamp('modified')} AS created_at,
  {m.sql_stamp('modified + INTERVAL 15 MINUTE')} AS expires_at FROM files""")
def files_to_envelopes(spark, folder):
    listing = m.files(spark, folder)
    # The id is taken from the name, so that the result does not depend on the run.
    name = F.regexp_extract("path", r"([^/.]+)(\.[^/]*)?$", 1)
    env = op.files_to_envelopes(listing, id=F.concat(F.lit("file-"), name), created_at=F.col("modificationTime"))
    return env.select("id", "source", "payload_size", "content_type", F.sha2("payload", 256).alias("checksum"),
                      m.stamp("created_at").alias("created_at"), m.stamp("expires_at").alias("expires_at"))


@query("requests_to_envelopes", """
SELECT 'page-' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'text/html' ELSE 'application/json' END AS content_type,
  'http' AS source, strlen(html) AS payload_size, sha256(html) AS checksum,
  'http-input:' || CASE WHEN page_id % 2 = 0 THEN '203.0.113.' || (page_id % 200)
                        ELSE '198.51.100.' || (page_id % 200) END AS path
FROM pages""")
def requests_to_envelopes(spark, folder):
    page = F.col("page_id")
    requests = m.table(spark, folder, "pages").select(
        F.concat(F.lit("page-"), page).alias("id"), F.col("html").alias("body"),
        F.create_map(
            F.lit("content-type"), F.when(page % 3 == 0, "text/html"),
            F.lit("X-Forwarded-For"), F.when(page % 2 == 0, F.concat(F.lit("203.0.113."), page % 200))
        ).alias("headers"),
        F.concat(F.lit("198.51.100."), page % 200, F.lit(":4711")).alias("remote_addr"),
        m.at().alias("received_at"))
    return op.requests_to_envelopes(requests).select(
        "id", "content_type", "source", "payload_size", F.sha2("payload", 256).alias("checksum"),
        F.array_join("step_history", ">").alias("path"))


@query("bus_to_envelopes", f"""
WITH {m.MESSAGES} SELECT 'events.' || tenant_id AS subject,
  CASE WHEN event_id % 3 = 0 THEN 'raw-' || event_id ELSE id END AS id,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE tenant_id END AS tenant_id,
  CASE WHEN event_id % 3 = 0 THEN 'nats' ELSE source END AS source,
  CASE WHEN event_id % 3 = 0 THEN 'application/octet-stream' ELSE 'application/json' END AS content_type,
  payload, payload_size, 'nats-input:events.' || tenant_id AS path
FROM messages""")
def bus_to_envelopes(spark, folder):
    env = m.messages(spark, folder)
    raw = F.col("event_id") % 3 == 0
    records = env.select(
        F.concat(F.lit("events."), "tenant_id").alias("subject"), "event_id",
        F.when(raw, F.col("payload").cast("string")).otherwise(envelope_to_json()).alias("value"),
        F.col("created_at").alias("ts"))
    return op.bus_to_envelopes(records, id=F.concat(F.lit("raw-"), "event_id")).select(
        "subject", "id", "tenant_id", "source", "content_type", F.col("payload").cast("string").alias("payload"),
        "payload_size", F.array_join("step_history", ">").alias("path"))


@query("to_bus_records", f"""
WITH {m.MESSAGES} SELECT id AS key, source || '.new.converted' AS subject, {ENVELOPE_JSON} AS value FROM messages""")
def bus_records(spark, folder):
    env = m.messages(spark, folder)
    return to_bus_records(env, F.concat("source", F.lit(".new")), stage="converted")


@query("merge_sources", """
SELECT content_type, source, count(*) AS messages, sum(size)::BIGINT AS total_bytes FROM (
  SELECT 'text/plain' AS content_type, role AS source, strlen(text) AS size FROM conversations
  UNION ALL SELECT 'application/octet-stream', source, strlen(text) FROM documents) AS merged
GROUP BY ALL""")
def merge_sources(spark, folder):
    talks = m.table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("id"), F.col("text").cast("binary").alias("payload"),
        F.lit("text/plain").alias("content_type"), F.col("role").alias("source"))
    papers = m.table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"), F.col("text").cast("binary").alias("payload"), "source", "lang")
    merged = op.merge_sources(talks, papers).withColumn(
        "content_type", F.coalesce("content_type", F.lit("application/octet-stream")))
    return (op.new_envelope(merged, created_at=m.at()).groupBy("content_type", "source")
            .agg(F.count(F.lit(1)).alias("messages"), F.sum("payload_size").alias("total_bytes")))
