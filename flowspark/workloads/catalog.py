"""Catalog joins, placement, quotas and versions."""

from pyspark.sql import functions as F

from .. import operators as op
from . import model as m
from .registry import query


@query("integration_catalog", f"""
WITH {m.INTEGRATIONS}, {m.TENANTS} SELECT i.id, t.name AS tenant_name, t.status AS tenant_status, i.status,
  c.p_name AS consumer_name, p.p_name AS producer_name
FROM integrations i JOIN tenants t ON t.id = i.tenant_id LEFT JOIN part c ON c.p_partkey = i.consumer_id
  LEFT JOIN part p ON p.p_partkey = i.producer_id""")
def integration_catalog(spark, folder):
    joined = op.integration_catalog(
        m.integrations(spark, folder), m.tenants(spark, folder), m.connectors(spark, folder))
    return joined.select("id", "tenant_name", "tenant_status", "status", "consumer_name", "producer_name")


@query("with_context", f"""
WITH {m.INTEGRATIONS} SELECT l_orderkey AS integration_id, l_linenumber AS line, l_partkey AS part, i.tenant_id,
  i.status FROM lineitem LEFT JOIN integrations i ON i.id = l_orderkey""")
def with_context(spark, folder):
    env = m.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("integration_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"))
    return op.with_context(env, m.integrations(spark, folder), ["tenant_id", "status"])


@query("active_only", f"""
WITH {m.INTEGRATIONS}, {m.TENANTS}, {m.MESSAGE_LOG} SELECT integration_id, line, payload_size FROM log
WHERE integration_id IN (SELECT id FROM integrations WHERE status = 'active'
                           AND tenant_id IN (SELECT id FROM tenants WHERE status = 'active'))""")
def active_only(spark, folder):
    return op.active_only(
        m.message_log(spark, folder), m.integrations(spark, folder), m.tenants(spark, folder),
    ).select("integration_id", "line", "payload_size")


@query("orphans", f"""
WITH {m.INTEGRATIONS} SELECT id, producer_id FROM integrations WHERE producer_id IS NOT NULL
  AND producer_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def orphans(spark, folder):
    known = m.table(spark, folder, "part").filter(F.col("p_size") < 25)
    return op.orphans(m.integrations(spark, folder), known, "producer_id", key="p_partkey").select("id", "producer_id")


@query("assign_instances", f"""
WITH {m.INTEGRATIONS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, instance_id IS NULL ORDER BY id) AS n FROM integrations)
SELECT id, tenant_id, coalesce(instance_id, CASE WHEN n <= 3 AND tenant_id % 2 = 0 THEN tenant_id + 1000 END, -1)
  AS instance_id FROM ranked""")
def assign_instances(spark, folder):
    rooms = m.tenants(spark, folder).filter(F.col("id") % 2 == 0).select(
        F.col("id").alias("tenant_id"), (F.col("id") + 1000).alias("instance_id"))
    return op.assign_instances(m.integrations(spark, folder), rooms, 3).select(
        "id", "tenant_id", F.coalesce("instance_id", F.lit(-1)).alias("instance_id"))


@query("place_integrations", f"""
WITH {m.INTEGRATIONS}, placed AS (
  SELECT id, tenant_id % 3 AS tenant_id, (row_number() OVER (PARTITION BY tenant_id % 3 ORDER BY id) - 1) // 50 + 1 AS n
  FROM integrations)
SELECT id, n AS instance_number, 'nats-' || tenant_id || '-' || n AS instance_name FROM placed""")
def place_integrations(spark, folder):
    owned = m.integrations(spark, folder).select("id", (F.col("tenant_id") % 3).alias("tenant_id"))
    return op.place_integrations(owned).select("id", "instance_number", "instance_name")


@query("quota_usage", f"""
WITH {m.INTEGRATIONS}, {m.TENANTS}, monthly AS (
  SELECT user_id AS tenant_id, date_trunc('month', ts) AS month, count(*) AS messages FROM events GROUP BY ALL),
owned AS (SELECT tenant_id, count(*) AS integrations FROM integrations GROUP BY ALL)
SELECT tenants.id AS tenant_id, strftime(month, '%Y-%m') AS month, coalesce(messages, 0) AS messages,
  coalesce(integrations, 0) AS integrations, coalesce(messages, 0) > max_messages_per_month AS over_messages,
  coalesce(integrations, 0) > max_integrations AS over_integrations
FROM tenants LEFT JOIN monthly ON tenants.id = monthly.tenant_id LEFT JOIN owned ON tenants.id = owned.tenant_id""")
def quota_usage(spark, folder):
    sent = m.table(spark, folder, "events").select(F.col("user_id").alias("tenant_id"), F.col("ts").alias("created_at"))
    usage = op.quota_usage(sent, m.integrations(spark, folder), m.tenants(spark, folder))
    return usage.select("tenant_id", F.date_format("month", "yyyy-MM").alias("month"), "messages", "integrations",
                        "over_messages", "over_integrations")


@query("capacity_status", f"""
WITH {m.INTEGRATIONS}, minutes AS (
  SELECT o_custkey AS tenant_id, o_orderkey % 7 AS minute, sum(o_orderkey) * 1000 AS n FROM orders
  WHERE o_orderkey % 7 < 5 GROUP BY ALL),
rates AS (SELECT tenant_id, CASE WHEN count(*) = 5 THEN min(n) / 60.0 ELSE 0 END AS message_rate FROM minutes GROUP BY 1),
instances AS (
  SELECT tenant_id, count(*) * 3 AS integration_count, max(id) % 1000 AS connection_count,
    any_value(coalesce(message_rate, 0)) AS message_rate
  FROM integrations LEFT JOIN rates USING (tenant_id) GROUP BY ALL)
SELECT tenant_id, integration_count, CASE WHEN integration_count >= 50 THEN 'full_integrations'
  WHEN message_rate > 100000 THEN 'full_rate' WHEN connection_count > 500 THEN 'full_connections'
  WHEN integration_count < 25 THEN 'scale_down' ELSE 'ok' END AS capacity_status FROM instances""")
def capacity_status(spark, folder):
    as_of = F.lit("2024-01-01 00:05:30").cast("timestamp")
    # Orders stand for counts of messages in seven minutes, two of which are too late to count.
    counts = m.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("tenant_id"), (F.col("o_orderkey") * 1000).alias("messages"),
        (F.lit("2024-01-01 00:00:10").cast("timestamp") + F.make_interval(mins=(F.col("o_orderkey") % 7).cast("int"))).alias("ts"))
    instances = m.integrations(spark, folder).groupBy("tenant_id").agg(
        (F.count(F.lit(1)) * 3).alias("integration_count"), (F.max("id") % 1000).alias("connection_count")).join(
        op.sustained_rate(counts, as_of=as_of, by="tenant_id"), "tenant_id", "left").withColumn(
        "message_rate", F.coalesce("message_rate", F.lit(0.0)))
    return op.capacity_status(instances).select("tenant_id", "integration_count", "capacity_status")


@query("latest_version", """
WITH plugins AS (SELECT p_brand AS name, p_size % 3 AS major, p_partkey % 12 AS minor, p_partkey % 31 AS patch,
  p_partkey % 4 AS rc FROM part),
versions AS (SELECT *, major || '.' || minor || CASE WHEN patch = 0 THEN '' ELSE '.' || patch END
  || CASE WHEN rc = 0 THEN '' ELSE '-rc.' || rc END AS version FROM plugins)
SELECT DISTINCT name, version FROM (SELECT *, row_number() OVER (
    PARTITION BY name ORDER BY minor DESC, patch DESC, rc = 0 DESC, rc DESC) AS n
  FROM versions WHERE major = 1 AND (minor > 2 OR minor = 2 AND (patch > 0 OR rc = 0))) WHERE n = 1""")
def latest_version(spark, folder):
    key = F.col("p_partkey")
    plugins = m.table(spark, folder, "part").select(
        F.col("p_brand").alias("name"), F.concat(
            F.concat_ws(".", F.col("p_size") % 3, key % 12, F.nullif(key % 31, F.lit(0))),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("-rc."), key % 4))).alias("version"))
    return op.latest_version(plugins, ">=1.2.0,<2.0.0")


@query("remap_tenant", """
SELECT event_id, CASE WHEN user_id % 5 < 3 THEN 'dedicated-' || (user_id % 5) ELSE 't' || (user_id % 5) END AS tenant_id
FROM events""")
def remap_tenant(spark, folder):
    moved = m.table(spark, folder, "nation").filter(F.col("n_nationkey") < 3).select(
        F.concat(F.lit("t"), "n_nationkey").alias("tenant_id"),
        F.concat(F.lit("dedicated-"), "n_nationkey").alias("new_tenant_id"))
    return op.remap_tenant(m.messages(spark, folder).select("event_id", "tenant_id"), moved)
