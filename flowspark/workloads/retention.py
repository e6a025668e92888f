"""Purges, expiry and replay."""

from pyspark.sql import functions as F

from .. import operators as op
from . import model as m
from .registry import query


@query("purge_completed", f"""
WITH {m.MESSAGE_LOG} SELECT integration_id, line, status, payload_size FROM log
WHERE NOT coalesce(status = 'completed' AND completed_at < TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR, false)""")
def purge_completed(spark, folder):
    kept = op.purge_completed(m.message_log(spark, folder), as_of=m.at(m.LOG_AS_OF_TEXT))
    return kept.select("integration_id", "line", "status", "payload_size")


@query("purge_archives", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS archive_date, count(*) AS rows FROM lineitem
WHERE l_shipdate::DATE >= DATE '1998-06-01' - 30 GROUP BY ALL""")
def purge_archives(spark, folder):
    archive = m.message_log(spark, folder).withColumn("archive_date", F.col("created_at").cast("date"))
    kept = op.purge_archives(archive, as_of=m.at(m.LOG_AS_OF_TEXT))
    return kept.groupBy(F.col("archive_date").cast("string").alias("archive_date")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("expired_archive_days", """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS archive_date, count(*) AS rows FROM lineitem
WHERE l_shipdate::DATE < DATE '1998-06-01' - 30 GROUP BY ALL""")
def expired_archive_days(spark, folder):
    archive = m.message_log(spark, folder).withColumn("archive_date", F.col("created_at").cast("date"))
    days = op.expired_archive_days(archive, as_of=m.at(m.LOG_AS_OF_TEXT))
    return days.select(F.col("archive_date").cast("string").alias("archive_date"), "rows")


@query("expired_objects", f"""
WITH {m.MESSAGES} SELECT 'app' AS rule, 'temp/' || tenant_id || '/messages/' || id || '.bin' AS key FROM messages
  WHERE event_id % 2 = 0 AND created_at <= TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTE
UNION ALL SELECT 'lifecycle', 'temp/' || tenant_id || '/messages/' || id || '.bin' FROM messages
  WHERE event_id % 2 = 0 AND created_at <= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY""")
def expired_objects(spark, folder):
    from ..functions import object_key
    prefix = F.when(F.col("event_id") % 2 == 0, "").otherwise("tenants/")
    listing = m.messages(spark, folder).select(
        F.concat(prefix, object_key(F.col("tenant_id"), F.col("id"))).alias("key"),
        F.col("created_at").alias("modificationTime"))
    as_of = m.at("2024-01-20 00:00:00")
    return op.merge_sources(
        op.expired_objects(listing, as_of=as_of).select(F.lit("app").alias("rule"), "key"),
        op.expired_objects(listing, as_of=as_of, ttl="1 day").select(F.lit("lifecycle").alias("rule"), "key"))


@query("replay", f"""
WITH {m.MESSAGES} SELECT id, 0 AS retry_count, '' AS last_error, '2024-01-31 00:15:00.000000' AS expires_at FROM messages
WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND source = 'error' AND tenant_id IN ('t1', 't4')""")
def replay(spark, folder):
    dead = m.messages(spark, folder).withColumns({
        "retry_count": F.lit(3), "last_error": F.lit("endpoint down"), "dead_at": F.col("created_at")})
    selection = (F.col("source") == "error") & F.col("tenant_id").isin("t1", "t4")
    return op.replay(dead, selection, as_of=m.at()).select(
        "id", "retry_count", F.coalesce("last_error", F.lit("")).alias("last_error"),
        m.stamp("expires_at").alias("expires_at"))


@query("purge_dead_letters", f"""
WITH {m.MESSAGES} SELECT tenant_id, count(*) AS kept FROM messages
WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY tenant_id""")
def purge_dead_letters(spark, folder):
    dead = m.messages(spark, folder).withColumn("dead_at", F.col("created_at"))
    return op.purge_dead_letters(dead, as_of=m.at()).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("kept"))
