"""Filters, validation and routing."""

from pyspark.sql import functions as F

from .. import operators as op
from . import model as m
from .registry import query


@query("validate_envelopes", f"""
WITH {m.MESSAGES} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'empty_id' WHEN event_id % 10 = 1 THEN 'null_payload'
  WHEN event_id % 10 = 2 THEN 'empty_payload' WHEN payload_size > 8 THEN 'payload_too_large' ELSE 'valid' END AS verdict
FROM messages""")
def validate_envelopes(spark, folder):
    kind = F.col("event_id") % 10
    env = m.messages(spark, folder).withColumns({
        "id": F.when(kind == 0, "").otherwise(F.col("id")),
        "payload": F.when(kind == 1, None).when(kind == 2, F.lit("").cast("binary")).otherwise(F.col("payload"))})
    valid, rejected = op.validate_envelopes(env, max_size=8)
    return op.merge_sources(
        valid.select("event_id", F.lit("valid").alias("verdict")),
        rejected.select("event_id", F.col("reject_reason").alias("verdict")))


@query("filter_field", f"""
WITH {m.ORDER_PAYLOADS} SELECT id FROM payloads WHERE o_totalprice > 250000 AND o_orderstatus = 'O'
  AND o_orderpriority LIKE '%URGENT%'""")
def filter_field(spark, folder):
    env = op.filter_field(m.order_payloads(spark, folder), "$.amount", ">", 250000)
    env = op.filter_field(env, "$.status", "=", "O")
    return op.filter_field(env, "$.priority", "contains", "URGENT").select("id")


@query("filter_pass_drop", f"""
WITH {m.ORDER_PAYLOADS} SELECT id, CASE WHEN o_totalprice > 1000 AND o_orderkey % 5 <> 0 THEN 'Pass' ELSE 'Drop' END
  AS decision FROM payloads""")
def filter_pass_drop(spark, folder):
    # A rule that is neither true nor false drops.
    rule = op.field_condition("$.amount", ">", 1000) & F.nullif(F.col("number") % 5 != 0, F.lit(False))
    env = m.order_payloads(spark, folder).withColumn("number", op.json_field("$.order_id").cast("bigint"))
    return op.filter_pass_drop(env, rule, keep_dropped=True).select("id", "decision")


@query("route", f"""
WITH {m.ORDER_PAYLOADS} SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'express'
  WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'standard' END
  AS route, count(*) AS messages FROM payloads GROUP BY 1""")
def route(spark, folder):
    routed = op.route_fields(m.order_payloads(spark, folder), [
        {"to": "express", "path": "$.priority", "op": "=", "value": "1-URGENT"},
        {"to": "fast", "path": "$.priority", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
        {"to": "archive", "path": "$.status", "op": "=", "value": "F"},
    ], default="standard")
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


@query("route_many", f"""
WITH {m.ORDER_PAYLOADS}, hits AS (
  SELECT id, 'express' AS route FROM payloads WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT id, 'audit' FROM payloads WHERE o_totalprice >= 400000
  UNION ALL SELECT id, 'archive' FROM payloads WHERE o_orderstatus = 'F')
SELECT id, route FROM hits
UNION ALL SELECT id, 'standard' FROM payloads WHERE id NOT IN (SELECT id FROM hits)""")
def route_many(spark, folder):
    return op.route_fields(m.order_payloads(spark, folder), [
        {"to": "express", "path": "$.priority", "op": "=", "value": "1-URGENT"},
        {"to": "audit", "path": "$.amount", "op": ">=", "value": 400000},
        {"to": "archive", "path": "$.status", "op": "=", "value": "F"},
    ], default="standard", many=True).select("id", "route")


@query("match_subject", f"""
WITH {m.MESSAGES} SELECT event_id, tenant_id || '.' || source || '.' || integration_id || '.new' AS subject FROM messages
WHERE source = 'click' OR tenant_id = 't3'""")
def match_subject(spark, folder):
    subject = F.concat_ws(".", "tenant_id", "source", "integration_id", F.lit("new"))
    env = m.messages(spark, folder).select("event_id", subject.alias("subject"))
    clicks = op.match_subject(env, "*.click.*.new")
    tenant = op.match_subject(env, "t3.>")
    return clicks.union(tenant).distinct()


@query("match_glob", f"""
WITH {m.FILES} SELECT doc_id, path FROM files WHERE regexp_matches(path, '/[0-9][^/]*[13579]\\.(json|csv)$')""")
def match_glob(spark, folder):
    files = m.files(spark, folder).select("doc_id", "path")
    return op.match_glob(files, "[0-9]*[13579].json").union(op.match_glob(files, "[^a-z]*[13579].c?v"))


@query("drop_settling", f"""
WITH {m.FILES} SELECT doc_id FROM files WHERE modified <= TIMESTAMP '2024-01-31 00:05:00' - INTERVAL 1 SECOND""")
def drop_settling(spark, folder):
    return op.drop_settling(m.files(spark, folder), as_of=m.at("2024-01-31 00:05:00")).select("doc_id")


@query("drop_expired", f"""
WITH {m.MESSAGES} SELECT id FROM messages WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00'""")
def drop_expired(spark, folder):
    return op.drop_expired(m.messages(spark, folder), as_of=m.at("2024-01-15 12:00:00")).select("id")


@query("filter_changes", f"""
WITH {m.CHANGES} SELECT lsn, op, table_name FROM changes WHERE table_name IN ('accounts_1', 'accounts_3')
  AND op IN ('I', 'D')""")
def filter_changes(spark, folder):
    kept = op.filter_changes(m.changes(spark, folder), tables=["accounts_1", "accounts_3"], ops=["I", "D"])
    return kept.select("lsn", "op", F.col("table").alias("table_name"))


@query("for_tenant", f"WITH {m.MESSAGES} SELECT id, payload_size FROM messages WHERE tenant_id = 't2'")
def for_tenant(spark, folder):
    return op.for_tenant(m.messages(spark, folder), "t2").select("id", "payload_size")


@query("assert_isolated", f"""
WITH {m.INTEGRATIONS} SELECT l_orderkey AS integration_id, l_linenumber AS line, l_suppkey AS tenant_id,
  i.tenant_id AS owner_tenant_id FROM lineitem JOIN integrations i ON i.id = l_orderkey WHERE l_suppkey <> i.tenant_id""")
def assert_isolated(spark, folder):
    env = m.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("integration_id"), F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("tenant_id"))
    return op.assert_isolated(env, m.integrations(spark, folder)).select(
        "integration_id", "line", "tenant_id", "owner_tenant_id")


@query("validate_payload", """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN '$: not JSON' ELSE concat_ws('; ',
    CASE WHEN o_orderkey % 7 = 0 THEN 'status: required' END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'order.amount: not number' END,
    CASE WHEN o_orderkey % 3 = 0 THEN 'order.lines: not array' END) END AS errors
FROM orders""")
def validate_payload(spark, folder):
    key, text = F.col("o_orderkey"), lambda column: F.concat(F.lit('"'), F.col(column), F.lit('"'))
    amount = F.when(key % 5 == 0, text("o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))
    lines = F.when(key % 3 == 0, F.lit("7")).otherwise(F.lit("[1,2]"))
    status = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"status":'), text("o_orderstatus"), F.lit(",")))
    body = F.concat(F.lit("{"), status, F.lit('"order":{"id":'), key, F.lit(',"amount":'), amount,
                    F.lit(',"lines":'), lines, F.lit("}}"))
    env = m.table(spark, folder, "orders").select(
        "o_orderkey", F.when(key % 13 == 0, F.lit("{broken")).otherwise(body).cast("binary").alias("payload"))
    checked = op.validate_payload(env, {
        "type": "object", "required": ["order", "status"],
        "properties": {"status": {"type": "string"}, "order": {"type": "object", "required": ["id"], "properties": {
            "id": {"type": "integer"}, "amount": {"type": "number"}, "lines": {"type": "array"}}}}})
    return checked.select("o_orderkey", F.array_join("payload_errors", "; ").alias("errors"))


@query("allow_list", """
SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]*\\.example\\.com/(fr|de)/.*$', 's')""")
def allow_list(spark, folder):
    pages = m.table(spark, folder, "pages").select("page_id", "url")
    return op.allow_list(pages, "url", [f"http{s}://*.example.com/{lang}/*" for s in ("", "s") for lang in ("fr", "de")])


@query("allow_list_values", """
SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def allow_list_values(spark, folder):
    customers = m.table(spark, folder, "customer")
    allowed = customers.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return op.allow_list(m.table(spark, folder, "events").select("event_id", "user_id"), "user_id", allowed).select(
        "event_id")
