"""Retention, replay, tenant moves and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import DEFAULT_TTL

DEAD_LETTER_DAYS = 7
ARCHIVE_DAYS = 30
LIFECYCLE_TTL = "1 day"


def purge_completed(log: DataFrame, *, as_of: Column, keep: str = "24 hours") -> DataFrame:
    """Drops completed rows older than ``keep``; unfinished rows and unknown times stay."""
    old = (F.col("status") == "completed") & (F.col("completed_at") < as_of - F.expr(f"INTERVAL {keep}"))
    return log.filter(~F.coalesce(old, F.lit(False)))


def purge_archives(archive: DataFrame, *, as_of: Column, days: int = ARCHIVE_DAYS, day: str = "archive_date") -> DataFrame:
    """What is left of an archive partitioned by ``day``. The filter prunes partitions."""
    return archive.filter(F.col(day) >= F.date_sub(as_of.cast("date"), days))


def expired_archive_days(
    archive: DataFrame, *, as_of: Column, days: int = ARCHIVE_DAYS, day: str = "archive_date"
) -> DataFrame:
    """The partitions to remove, with what they hold."""
    return (archive.filter(F.col(day) < F.date_sub(as_of.cast("date"), days))
            .groupBy(day).agg(F.count(F.lit(1)).alias("rows")))


def expired_objects(listing: DataFrame, *, as_of: Column, ttl: str = DEFAULT_TTL, prefix: str = "temp/") -> DataFrame:
    """Objects below ``prefix`` past their time to live, by application (15 minutes) or lifecycle (1 day)."""
    return listing.filter(F.startswith(F.col("key"), F.lit(prefix))
                          & (F.col("modificationTime") <= as_of - F.expr(f"INTERVAL {ttl}")))


def purge_dead_letters(dead: DataFrame, *, as_of: Column, days: int = DEAD_LETTER_DAYS) -> DataFrame:
    return dead.filter(F.col("dead_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def replay(dead: DataFrame, selection: Column, *, as_of: Column, ttl: str = DEFAULT_TTL) -> DataFrame:
    """Dead letters put back: no retries counted, no error, a new expiry."""
    return purge_dead_letters(dead, as_of=as_of).filter(selection).withColumns({
        "retry_count": F.lit(0),
        "last_error": F.lit(None).cast("string"),
        "expires_at": as_of + F.expr(f"INTERVAL {ttl}"),
    }).drop("dead_at")


def remap_tenant(env: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves messages between tenants by a frame (tenant_id, new_tenant_id)."""
    return (env.join(moves.select("tenant_id", "new_tenant_id"), "tenant_id", "left")
            .withColumn("tenant_id", F.coalesce("new_tenant_id", "tenant_id")).drop("new_tenant_id"))


def audit_trail(audit: DataFrame, *, unit: str = "day") -> DataFrame:
    """Actions per tenant and period."""
    return audit.groupBy("tenant_id", "action", F.date_trunc(unit, "created_at").alias("period")).agg(
        F.count(F.lit(1)).alias("actions"), F.max("created_at").alias("last_at"))
