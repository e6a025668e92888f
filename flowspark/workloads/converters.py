"""Payload conversions, enrichment and user functions."""

import json

from pyspark.sql import functions as F

from .. import operators as op
from ..functions import unpacked
from . import model as m
from .registry import query

ORDER_SCHEMA = "order_id BIGINT, amount DOUBLE, status STRING, priority STRING"


@query("map_json", f"""
WITH {m.ORDER_PAYLOADS} SELECT id, o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
  'USD' AS currency, tenant_id AS customer, o_orderstatus AS status, 'number' AS order_id_type FROM payloads""")
def map_json(spark, folder):
    env = op.map_json(m.order_payloads(spark, folder), {
        "order_id": "$.order_id",
        "total": {"path": "$.amount", "multiply": 100, "type": "decimal(18,2)"},
        "currency": {"const": "USD"},
        "customer": {"context": "tenant_id"},
        "status": "$.status"})
    kind = F.when(F.col("payload").cast("string").rlike(r'"order_id":\d+,'), "number").otherwise("text")
    names = ["order_id", "total", "currency", "customer", "status"]
    return env.select("id", kind.alias("order_id_type"), F.json_tuple(F.col("payload").cast("string"), *names).alias(
        *names)).select("id", F.col("order_id").cast("bigint").alias("order_id"),
                        F.col("total").cast("decimal(20,2)").cast("bigint").alias("total_cents"), "currency",
                        "customer", "status", "order_id_type")


@query("xml_to_json", f"""
WITH {m.ORDER_PAYLOADS} SELECT id, o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  o_orderstatus AS status, o_orderpriority AS priority, 'application/json' AS content_type FROM payloads""")
def xml_to_json(spark, folder):
    xml = op.json_to_xml(m.order_payloads(spark, folder), ORDER_SCHEMA, row_tag="order")
    env = op.xml_to_json(xml, ORDER_SCHEMA, row_tag="order")
    return _order_columns(env)


def _order_columns(env):
    document = F.from_json(F.col("payload").cast("string"), ORDER_SCHEMA)
    return env.select("id", "content_type", unpacked(document, ["order_id", "amount", "status", "priority"])).select(
        "id", "order_id", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "status", "priority",
        "content_type")


@query("json_to_xml", """
SELECT 'order-' || o_orderkey AS id, 'application/xml' AS content_type, concat_ws(chr(10), '<order>',
  '    <order_id>' || o_orderkey || '</order_id>', '    <amount>' || o_totalprice || '</amount>',
  '    <status>' || o_orderstatus || '</status>', '    <priority>' || o_orderpriority || '</priority>',
  '</order>') AS body FROM orders""")
def json_to_xml(spark, folder):
    env = op.json_to_xml(m.order_payloads(spark, folder), ORDER_SCHEMA, row_tag="order")
    return env.select("id", "content_type", F.col("payload").cast("string").alias("body"))


@query("csv_to_json", f"""
WITH {m.ORDER_PAYLOADS} SELECT id, o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  o_orderstatus AS status, o_orderpriority AS priority, 'application/json' AS content_type FROM payloads""")
def csv_to_json(spark, folder):
    orders = m.table(spark, folder, "orders")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"),
                       "o_orderstatus", "o_orderpriority")
    env = orders.select(F.concat(F.lit("order-"), "o_orderkey").alias("id"),
                        F.concat(F.lit("order_id,amount,status,priority\r\n"), line, F.lit("\r\n"))
                        .cast("binary").alias("payload"))
    return _order_columns(op.csv_to_json(env, ORDER_SCHEMA, header=True))


# Payloads by the last digit of the order: what becomes of each, and how many messages it makes.
ODD_JSON = {0: ('{"order_id":1,"amount":2.5}', None), 1: ("[1,2]", "not a JSON object"), 2: ('"x"', "not a JSON object"),
            3: ("5", "not a JSON object"), 4: ("null", "not a JSON object"),
            5: ('{"order_id":"none","amount":"much"}', "fields not converted: order_id, amount"), 6: ("", "malformed JSON"),
            7: (None, "malformed JSON"), 8: ('{"other":1}', None), 9: ('{"order_id":', "malformed JSON")}
ODD_XML = {0: ("<o><order_id>1</order_id></o>", None, '{"order_id":1}'),
           1: ("<all>\n<o><order_id>1</order_id></o><o><order_id>2</order_id></o></all>", None, '[{"order_id":1},{"order_id":2}]'),
           2: ("<o><b>1</b></o>", "no field of the schema", None), 3: ("<o><order_id>1", "malformed XML", None),
           4: ("", "empty payload", None), 5: (None, "empty payload", None),
           6: ("<o><order_id>none</order_id></o>", "malformed XML", None), 7: ("<x><y>1</y></x>", "malformed XML", None),
           8: ('<?xml version="1.0"?><o/>', None, "{}"), 9: ("<all/>", "malformed XML", None)}
ODD_CSV = {0: ("id,amount\n1,2.5\n2,3.5\n", [None, None]), 1: ("id,amount\n", ["no lines"]), 2: ("", ["no lines"]),
           3: (None, ["no lines"]), 4: ("id,amount\n1,2.5\nx,y,z\n", [None, "malformed CSV line"]), 5: ("\n\n", ["no lines"]),
           6: ("id,amount", ["no lines"]), 7: ("id,amount\r\n7,1.5", [None]), 8: ("id,amount\none,1.5\n", ["malformed CSV line"]),
           9: ("id,amount\n1,1.0\n\n2,2.0", [None, None])}


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '") + "'"


def _odd(spark, folder, payloads: dict[int, str | None]):
    """Orders with the odd payload of their key's last digit."""
    digit = F.col("o_orderkey") % 10
    body = F.coalesce(*[F.when(digit == k, F.lit(text)) for k, text in payloads.items() if text is not None])
    return m.table(spark, folder, "orders").select(
        "o_orderkey", digit.alias("digit"), body.cast("binary").alias("payload"), F.lit("text/plain").alias("content_type"))


def _listed(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(_quoted(x) if isinstance(x, str | None) else str(x) for x in row)})" for row in rows)


@query("map_json_odd_payloads", f"""
WITH kinds(digit, given, error) AS (VALUES {_listed([
    (k, text, "fields not converted: n, cents" if k == 5 else error or "") for k, (text, error) in ODD_JSON.items()])})
SELECT o_orderkey, coalesce(CASE error WHEN '' THEN CASE digit WHEN 0 THEN '{{"n":1,"cents":250.0,"cur":"USD"}}'
    ELSE '{{"cur":"USD"}}' END ELSE given END, 'NULL') AS payload, error FROM orders JOIN kinds ON o_orderkey % 10 = digit""")
def map_json_odd_payloads(spark, folder):
    env = op.map_json(_odd(spark, folder, {k: text for k, (text, _) in ODD_JSON.items()}), {
        "n": {"path": "$.order_id", "type": "bigint"}, "cents": {"path": "$.amount", "multiply": 100},
        "cur": {"const": "USD"}})
    return env.select("o_orderkey", F.coalesce(F.col("payload").cast("string"), F.lit("NULL")).alias("payload"),
                      F.coalesce("conversion_error", F.lit("")).alias("error"))


@query("json_to_xml_odd_payloads", f"""
WITH kinds(digit, given, error) AS (VALUES {_listed([
    (k, text, "no field of the schema" if k == 8 else error or "") for k, (text, error) in ODD_JSON.items()])})
SELECT o_orderkey, coalesce(CASE error WHEN '' THEN concat_ws(chr(10), '<o>', '    <order_id>1</order_id>',
    '    <amount>2.5</amount>', '</o>') ELSE given END, 'NULL') AS payload, error FROM orders JOIN kinds ON o_orderkey % 10 = digit""")
def json_to_xml_odd_payloads(spark, folder):
    env = op.json_to_xml(_odd(spark, folder, {k: text for k, (text, _) in ODD_JSON.items()}), "order_id BIGINT, amount DOUBLE", "o")
    return env.select("o_orderkey", F.coalesce(F.col("payload").cast("string"), F.lit("NULL")).alias("payload"),
                      F.coalesce("conversion_error", F.lit("")).alias("error"))


@query("xml_to_json_odd_payloads", f"""
WITH kinds(digit, given, error, made) AS (VALUES {_listed([(k, text, error or "", made) for k, (text, error, made) in ODD_XML.items()])})
SELECT o_orderkey, coalesce(made, given, 'NULL') AS payload, error FROM orders JOIN kinds ON o_orderkey % 10 = digit""")
def xml_to_json_odd_payloads(spark, folder):
    env = op.xml_to_json(_odd(spark, folder, {k: row[0] for k, row in ODD_XML.items()}), "order_id BIGINT", "o")
    return env.select("o_orderkey", F.coalesce(F.col("payload").cast("string"), F.lit("NULL")).alias("payload"),
                      F.coalesce("conversion_error", F.lit("")).alias("error"))


@query("csv_to_json_odd_payloads", f"""
WITH kinds(digit, line, error) AS (VALUES {_listed([
    (k, at if errors != ["no lines"] else -1, error or "") for k, (_, errors) in ODD_CSV.items() for at, error in enumerate(errors)])})
SELECT o_orderkey, line::INTEGER AS line_number, error FROM orders JOIN kinds ON o_orderkey % 10 = digit""")
def csv_to_json_odd_payloads(spark, folder):
    env = op.csv_to_json(_odd(spark, folder, {k: text for k, (text, _) in ODD_CSV.items()}), "id INT, amount DOUBLE", header=True)
    return env.select("o_orderkey", F.coalesce("line_number", F.lit(-1)).alias("line_number"),
                      F.coalesce("conversion_error", F.lit("")).alias("error"))


@query("convert_types", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS user_id,
  CAST(round(value * 100) AS BIGINT) AS cents,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS happened_at,
  concat_ws(',', CASE WHEN event_id % 6 = 0 AND event_id % 2 = 0 AND event_id % 12 <> 0 THEN 'user_id' END,
                 CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN 'happened_at' END) AS errors
FROM events""")
def convert_types(spark, folder):
    key = F.col("event_id")
    body = F.to_json(F.struct(
        F.when(key % 12 == 0, None).when(key % 6 == 0, "no number").otherwise(F.col("user_id").cast("string"))
        .alias("user_id"),
        F.col("value"),
        F.when(key % 8 == 0, None).when(key % 4 == 0, "never")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("happened_at")))
    env = m.table(spark, folder, "events").select("event_id", body.cast("binary").alias("payload"))
    typed = op.convert_types(env, "user_id bigint, value decimal(12,2), happened_at timestamp")
    return typed.select(
        "event_id", "user_id", (F.col("value") * 100).cast("bigint").alias("cents"),
        F.date_format("happened_at", "yyyy-MM-dd HH:mm:ss").alias("happened_at"),
        F.array_join("conversion_errors", ",").alias("errors"))


@query("enrich", """
SELECT o_orderkey, n_name, r_name, CAST(round(o_totalprice * 100) AS BIGINT) * (n_nationkey + 1) AS converted
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey""")
def enrich(spark, folder):
    rates = m.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"),
        (F.col("n_nationkey") + 1).alias("rate"))
    customers = m.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    env = op.enrich(m.table(spark, folder, "orders"), customers, "o_custkey")
    env = op.enrich(op.enrich(env, rates, "c_nationkey"), m.table(spark, folder, "region"), "r_regionkey")
    return env.select("o_orderkey", "n_name", "r_name",
                      (F.round(F.col("o_totalprice") * 100).cast("bigint") * F.col("rate")).alias("converted"))


@query("changes_to_envelopes", f"""
WITH {m.CHANGES} SELECT 'lsn-' || lsn AS id, CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END
    AS operation, txid, table_name, CASE WHEN op <> 'I' THEN value::VARCHAR END AS before_value,
  CASE WHEN op <> 'D' THEN value::VARCHAR END AS after_value, {m.sql_stamp('ts')} AS created_at FROM changes""")
def changes_to_envelopes(spark, folder):
    env = op.changes_to_envelopes(m.changes(spark, folder)).drop("operation")
    document = F.from_json(
        F.col("payload").cast("string"),
        "operation string, txid bigint, table string, before map<string,string>, after map<string,string>")
    return env.select("id", "created_at", unpacked(document, ["operation", "txid", "table_name", "before", "after"])).select(
        "id", "operation", "txid", "table_name", F.col("before")["value"].alias("before_value"),
        F.col("after")["value"].alias("after_value"), m.stamp("created_at").alias("created_at"))


def _to_minor_units(message, context):
    order = json.loads(message["payload"])
    if order["status"] == "P":
        raise ValueError("order is pending")
    order["total"] = round(order["amount"] * context["config"]["factor"])
    return {"payload": json.dumps(order)}


@query("convert_with", f"""
WITH {m.ORDER_PAYLOADS} SELECT id, CASE WHEN o_orderstatus = 'P' THEN NULL
    ELSE CAST(round(o_totalprice * 100) AS BIGINT)::VARCHAR END AS total,
  CASE WHEN o_orderstatus = 'P' THEN 'ValueError: order is pending' ELSE '' END AS last_error FROM payloads""")
def convert_with(spark, folder):
    env = m.order_payloads(spark, folder).select("id", "tenant_id", "payload", "payload_size", "last_error")
    converted, failed = op.convert_with(env, _to_minor_units, config={"factor": 100})
    return converted.unionByName(failed).select(
        "id", op.json_field("$.total").alias("total"), F.coalesce("last_error", F.lit("")).alias("last_error"))


def _is_large_open_order(message, context):
    order = json.loads(message["payload"])
    return order["amount"] > context["config"]["minimum"] and order["status"] == "O"


@query("filter_with", f"WITH {m.ORDER_PAYLOADS} SELECT id FROM payloads WHERE o_totalprice > 100000 "
                      "AND o_orderstatus = 'O'")
def filter_with(spark, folder):
    env = m.order_payloads(spark, folder).select("id", "payload")
    return op.filter_with(env, _is_large_open_order, config={"minimum": 100000}).select("id")
