"""Joins and quotas over the catalog of tenants, connectors, integrations and bus instances.

No join here carries a broadcast hint. The planner broadcasts a side whose size it knows to be small and
shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import ordered_scan

INSTANCE_CAPACITY = 50
MAX_RATE_PER_SECOND = 100_000
MAX_CONNECTIONS = 500
SCALE_DOWN_BELOW = 25


def integration_catalog(integrations: DataFrame, tenants: DataFrame, connectors: DataFrame) -> DataFrame:
    """Integrations with the names of their tenant, consumer and producer; connectors may be missing."""
    owner = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant_name"),
                           F.col("status").alias("tenant_status"))
    consumer = connectors.select(F.col("id").alias("consumer_id"), F.col("name").alias("consumer_name"))
    producer = connectors.select(F.col("id").alias("producer_id"), F.col("name").alias("producer_name"))
    return (integrations.join(owner, "tenant_id")
            .join(consumer, "consumer_id", "left")
            .join(producer, "producer_id", "left"))


def with_context(env: DataFrame, integrations: DataFrame, columns: list[str]) -> DataFrame:
    """Adds settings of the message's integration. Works on streams against a static catalog."""
    settings = integrations.select(F.col("id").alias("integration_id"), *columns)
    return env.join(settings, "integration_id", "left")


def active_only(env: DataFrame, integrations: DataFrame, tenants: DataFrame) -> DataFrame:
    """Messages of active integrations of active tenants."""
    active_tenants = tenants.filter(F.col("status") == "active").select(F.col("id").alias("tenant_id"))
    running = (integrations.filter(F.col("status") == "active")
               .join(active_tenants, "tenant_id", "left_semi")
               .select(F.col("id").alias("integration_id")))
    return env.join(running, "integration_id", "left_semi")


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Child rows whose reference points nowhere; a NULL reference is allowed."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti")


def assign_instances(integrations: DataFrame, instances: DataFrame, limit: int) -> DataFrame:
    """Gives each tenant's first ``limit`` unassigned integrations (by id) to its instance in ``instances``.

    ``instances`` has one row (tenant_id, instance_id) per tenant with room.
    """
    numbered = ordered_scan(
        integrations.filter(F.col("instance_id").isNull()).select("id", "tenant_id"),
        ["tenant_id"], ["id"], rank="position")
    chosen = (numbered.filter(F.col("position") <= limit)
              .join(instances.select("tenant_id", F.col("instance_id").alias("given_instance")), "tenant_id")
              .select("id", "given_instance"))
    return (integrations.join(chosen, "id", "left")
            .withColumn("instance_id", F.coalesce("instance_id", "given_instance"))
            .drop("given_instance"))


def place_integrations(integrations: DataFrame, capacity: int = INSTANCE_CAPACITY) -> DataFrame:
    """Instance number and name by position within the tenant, ``capacity`` integrations to an instance."""
    ranked = ordered_scan(integrations, ["tenant_id"], ["id"], rank="position")
    number = F.floor((F.col("position") - 1) / capacity) + 1
    return ranked.withColumns({
        "instance_number": number,
        "instance_name": F.concat_ws("-", F.lit("nats"), F.col("tenant_id"), number.cast("string")),
    })


def quota_usage(messages: DataFrame, integrations: DataFrame, tenants: DataFrame) -> DataFrame:
    """Messages per tenant and month, and integrations per tenant, against the tenant's limits.

    Every tenant is listed; one without messages has a NULL month.
    """
    monthly = messages.groupBy("tenant_id", F.date_trunc("month", "created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("messages"))
    owned = integrations.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("integrations"))
    limits = tenants.select(F.col("id").alias("tenant_id"), "max_messages_per_month", "max_integrations")
    return (limits.join(monthly, "tenant_id", "left").join(owned, "tenant_id", "left")
            .withColumns({name: F.coalesce(name, F.lit(0).cast("bigint")) for name in ("messages", "integrations")})
            .withColumns({
                "over_messages": F.col("messages") > F.col("max_messages_per_month"),
                "over_integrations": F.col("integrations") > F.col("max_integrations"),
            }))


def capacity_status(instances: DataFrame, sustained_rate: Column | None = None) -> DataFrame:
    """What to do with each instance row (integration_count, message_rate, connection_count).

    ``message_rate`` is the lowest rate over the last five minutes, so that exceeding the limit means it
    was exceeded all the time.
    """
    rate = sustained_rate if sustained_rate is not None else F.col("message_rate")
    return instances.withColumn(
        "capacity_status",
        F.when(F.col("integration_count") >= INSTANCE_CAPACITY, "full_integrations")
        .when(rate > MAX_RATE_PER_SECOND, "full_rate")
        .when(F.col("connection_count") > MAX_CONNECTIONS, "full_connections")
        .when(F.col("integration_count") < SCALE_DOWN_BELOW, "scale_down")
        .otherwise("ok"))


def latest_version(plugins: DataFrame, allowed: str, name: str = "name", version: str = "version") -> DataFrame:
    """Newest version of each name within a range, in semantic order."""
    from ..functions import in_range, version_key

    newest_first = Window.partitionBy(name).orderBy(version_key(F.col(version)).desc(), F.col(version).desc())
    return (plugins.filter(in_range(F.col(version), allowed))
            .withColumn("__position", F.row_number().over(newest_first))
            .filter(F.col("__position") == 1).drop("__position"))
