"""Aggregates, rates and alerts."""

from pyspark.sql import functions as F

from .. import operators as op
from . import model as m
from .registry import query


@query("integration_stats", f"""
WITH {m.MESSAGE_LOG} SELECT integration_id, count(*) AS message_count,
  count(*) FILTER (status IN ('retry', 'dead_letter')) AS error_count, {m.sql_stamp('max(created_at)')} AS last_run_at
FROM log GROUP BY integration_id""")
def integration_stats(spark, folder):
    return op.integration_stats(m.message_log(spark, folder)).withColumn("last_run_at", m.stamp("last_run_at"))


@query("delivery_quality", """
WITH ranked AS (SELECT user_id % 5 AS tenant, value, event_type <> 'error' AS ok,
  row_number() OVER (PARTITION BY user_id % 5 ORDER BY value) AS n, count(*) OVER (PARTITION BY user_id % 5) AS total
  FROM events)
SELECT tenant, count(*) AS messages, round(avg(ok::INT), 6) AS success_rate,
  max(value) FILTER (n = ceil(total * 0.5)) AS p50, max(value) FILTER (n = ceil(total * 0.95)) AS p95,
  max(value) FILTER (n = ceil(total * 0.99)) AS p99
FROM ranked GROUP BY tenant""")
def delivery_quality(spark, folder):
    reports = m.table(spark, folder, "events").select(
        (F.col("user_id") % 5).alias("tenant"), (F.col("event_type") != "error").alias("delivered"),
        F.col("value").alias("latency_ms"))
    return op.delivery_quality(reports, ["tenant"]).withColumn("success_rate", F.round("success_rate", 6))


@query("bucket_totals", f"""
WITH {m.MESSAGES} SELECT source, tenant_id, count(*) AS row_count, sum(payload_size)::BIGINT AS total_bytes,
  round(avg(payload_size), 6) AS avg_bytes FROM messages GROUP BY ALL""")
def bucket_totals(spark, folder):
    totals = op.bucket_totals(m.messages(spark, folder), ["source", "tenant_id"])
    return totals.withColumn("avg_bytes", F.round("avg_bytes", 6))


@query("status_counts", f"""
WITH {m.MESSAGE_LOG} SELECT status, count(*) AS messages, status = 'dead_letter' AND count(*) > 10000 AS alarm
FROM log GROUP BY status""")
def status_counts(spark, folder):
    return op.status_counts(m.message_log(spark, folder))


@query("top_by_size", f"""
WITH {m.MESSAGE_LOG} SELECT integration_id, sum(payload_size)::BIGINT AS total_bytes FROM log
GROUP BY integration_id ORDER BY total_bytes DESC, integration_id LIMIT 25""")
def top_by_size(spark, folder):
    return op.top_by_size(m.message_log(spark, folder), "integration_id", 25)


@query("message_rate", f"""
WITH {m.MESSAGES}, spread AS (
  SELECT tenant_id, time_bucket(INTERVAL 1 MINUTE, created_at) - to_minutes(k) AS start FROM messages, range(5) r(k))
SELECT tenant_id, {m.sql_stamp('start')} AS window_start, count(*) AS messages,
  round(count(*) / 300.0, 9) AS per_second FROM spread GROUP BY ALL""")
def message_rate(spark, folder):
    rates = op.message_rate(m.messages(spark, folder), width="5 minutes", slide="1 minute")
    return rates.select("tenant_id", m.stamp("window_start").alias("window_start"), "messages",
                        F.round("per_second", 9).alias("per_second"))


@query("rate_limit_flags", """
SELECT event_id, user_id % 3 AS key, n AS request_number, n > 1 AS over_limit FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('minute', ts) ORDER BY ts, event_id)
    AS n FROM events)""")
def rate_limit_flags(spark, folder):
    requests = m.table(spark, folder, "events").select("event_id", (F.col("user_id") % 3).alias("key"), "ts")
    flagged = op.rate_limit_flags(requests, limit=1, order=["ts", "event_id"])
    return flagged.select("event_id", "key", "request_number", "over_limit")


@query("sustained_alert", f"""
WITH hourly AS (SELECT user_id % 4 AS instance, date_trunc('hour', ts) AS ts, max(value) AS peak FROM events GROUP BY ALL),
numbered AS (SELECT *, sum(CASE WHEN peak > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY instance ORDER BY ts) AS episode
  FROM hourly),
episodes AS (SELECT instance, episode, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) AS samples FROM numbered
  WHERE peak > 40 GROUP BY ALL)
SELECT instance, {m.sql_stamp('started_at')} AS started_at, {m.sql_stamp('last_seen_at')} AS last_seen_at, samples,
  {m.sql_stamp('started_at + INTERVAL 3 HOUR')} AS fired_at
FROM episodes WHERE last_seen_at >= started_at + INTERVAL 3 HOUR""")
def sustained_alert(spark, folder):
    samples = m.table(spark, folder, "events").select(
        (F.col("user_id") % 4).alias("instance"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
    hourly = samples.groupBy("instance", "ts").agg(F.max("value").alias("peak"))
    alerts = op.sustained_alert(hourly, ["instance"], F.col("peak") > 40, hold="3 hours", sample_from=samples)
    return alerts.select("instance", m.stamp("started_at").alias("started_at"),
                         m.stamp("last_seen_at").alias("last_seen_at"), "samples", m.stamp("fired_at").alias("fired_at"))


@query("audit_trail", f"""
WITH {m.MESSAGES} SELECT tenant_id, source AS action, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS period,
  count(*) AS actions, {m.sql_stamp('max(created_at)')} AS last_at FROM messages GROUP BY ALL""")
def audit_trail(spark, folder):
    audit = m.messages(spark, folder).withColumn("action", F.col("source"))
    return op.audit_trail(audit).select(
        "tenant_id", "action", F.date_format("period", "yyyy-MM-dd").alias("period"), "actions",
        m.stamp("last_at").alias("last_at"))
