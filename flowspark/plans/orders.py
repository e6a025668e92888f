"""Order processing: validate, convert, filter, route to several destinations, total per route."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import map_json, new_envelope, route, validate_envelopes, with_json_fields

MAPPING = {
    "id": "$.order_id",
    "total": {"path": "$.amount", "multiply": 100, "type": "decimal(18,2)"},
    "currency": {"const": "USD"},
    "status": "$.status",
    "priority": "$.priority",
}


def order_messages(orders: DataFrame) -> DataFrame:
    """Orders as JSON messages."""
    body = F.to_json(F.struct(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    landed = orders.select(
        F.concat(F.lit("order-"), "o_orderkey").alias("id"),
        F.concat(F.lit("t"), F.col("o_custkey") % 5).alias("tenant_id"),
        F.concat(F.lit("i"), F.col("o_custkey") % 20).alias("integration_id"),
        body.cast("binary").alias("payload"),
        F.lit("application/json").alias("content_type"),
        F.lit("http").alias("source"),
        F.col("o_orderdate").alias("created_at"))
    return new_envelope(landed, created_at=F.col("created_at"))


def order_workflow(orders: DataFrame, *, minimum: float = 10_000_000) -> DataFrame:
    """Valid orders above ``minimum`` cents, routed by priority and status: count and cents per route."""
    valid, _ = validate_envelopes(order_messages(orders))
    converted = map_json(valid, MAPPING)
    fields, at = with_json_fields(converted, ["$.total", "$.status", "$.priority"])
    total, status, priority = at["$.total"].cast("decimal(20,2)"), at["$.status"], at["$.priority"]
    large = fields.filter(total > minimum)
    routed = route(large, [
        ("express", priority == "1-URGENT"),
        ("priority", (priority == "2-HIGH") & (status != "F")),
        ("archive", status == "F"),
    ], default="standard")
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(total.cast("bigint")).alias("total_cents"))
