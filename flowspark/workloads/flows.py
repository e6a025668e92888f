"""Whole flows."""

import json

from pyspark.sql import functions as F

from .. import plans, streaming
from ..session import shared_dir
from ..sources.registry import register_source
from . import model as m
from .files import _landed
from .registry import query

ROUTED = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'express'
    WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' THEN 'priority'
    WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'standard' END"""


@query("order_workflow", f"""
SELECT {ROUTED} AS route, count(*) AS messages, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total_cents
FROM orders WHERE round(o_totalprice * 100) > 10000000 GROUP BY 1""")
def order_workflow(spark, folder):
    return plans.order_workflow(m.table(spark, folder, "orders"))


def _to_cents(message, context):
    order = json.loads(message["payload"])
    if order["order_id"] % 17 == 0:
        raise ValueError("bad order")
    order["total"] = round(order["amount"] * 100)
    return {"payload": json.dumps(order)}


STEPS = [
    {"kind": "validate"},
    {"kind": "step", "name": "validated"},
    {"kind": "convert", "function": "to_cents"},
    {"kind": "filter", "path": "$.total", "op": ">", "value": 10_000_000},
    {"kind": "route", "default": "standard", "rules": [
        {"to": "express", "path": "$.priority", "op": "=", "value": "1-URGENT"},
        {"to": "archive", "path": "$.status", "op": "=", "value": "F"}]},
]

FLOW_ROUTE = """CASE WHEN o_orderkey % 17 = 0 THEN 'dead_letter' WHEN round(o_totalprice * 100) <= 10000000 THEN 'dropped'
    WHEN o_orderpriority = '1-URGENT' THEN 'express' WHEN o_orderstatus = 'F' THEN 'archive' ELSE 'standard' END"""


@query("run_flow", f"""
SELECT {FLOW_ROUTE} AS route, count(*) AS messages, count(*) FILTER ({FLOW_ROUTE} IN ('express', 'archive')) AS sent
FROM orders GROUP BY 1""")
def run_flow(spark, folder):
    register_source("orders", lambda session, options: m.order_payloads(session, options["folder"]))
    sent = shared_dir(spark, "sent")
    report = plans.run_flow(spark, {
        "source": {"type": "orders", "options": {"folder": folder}}, "steps": STEPS,
        "sinks": {name: {"type": "envelopes", "options": {"path": f"{sent}/to={name}"}}
                  for name in ("express", "archive")} | {"standard": None},
    }, functions={"to_cents": _to_cents})
    delivered = spark.read.parquet(sent).groupBy(F.col("to").alias("route")).agg(F.count(F.lit(1)).alias("sent"))
    return report.join(delivered, "route", "left").select(
        "route", "messages", F.coalesce("sent", F.lit(0).cast("bigint")).alias("sent"))


@query("run_flow_stream", f"""
SELECT {FLOW_ROUTE} AS route, count(*) AS messages FROM orders GROUP BY 1""")
def run_flow_stream(spark, folder):
    """All five routes, each to a built-in sink, over several micro-batches."""
    session = streaming.stream_session(spark, timers=False)
    schema = m.table(session, folder, "orders").schema
    home = shared_dir(spark, "flow-stream")
    # Four micro-batches, each with a file for every core: a file of one row group is read by one task.
    cores = max(2, spark.sparkContext.defaultParallelism)
    m.table(spark, folder, "orders").repartition(4 * cores).write.parquet(f"{home}/in")
    orders = session.readStream.schema(schema).option("maxFilesPerTrigger", cores).parquet(f"{home}/in")
    run = plans.run_flow_stream(plans.order_messages(orders), {
        "steps": STEPS,
        "sinks": {name: {"type": "envelopes", "options": {"path": f"{home}/sent/to={name}"}}
                  for name in ("express", "archive", "standard", "dropped", "dead_letter")},
    }, f"{home}/stage", f"{home}/checkpoint", functions={"to_cents": _to_cents}, availableNow=True)
    run.awaitTermination()
    return spark.read.parquet(f"{home}/sent").groupBy(F.col("to").alias("route")).agg(
        F.count(F.lit(1)).alias("messages"))


class Answer:
    """What an opened request gives."""

    def __init__(self, status):
        self.status = status

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None


def _endpoint(request, timeout):
    """Accepts message n after n % 5 failures; n % 5 = 4 never answers. The body is the envelope."""
    message = json.loads(request.data)
    kind = int(message["id"].split("-")[1]) % 5
    if kind == 4:
        raise ConnectionError("refused")
    return Answer(200 if message.get("retry_count", 0) >= kind else 503)


@query("run_flow_retries", f"""
WITH {m.MESSAGES} SELECT id, least(event_id % 5, 3) AS failures, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE 4 END AS passes,
  [0, 1000, 3000, 7000][least(event_id % 5, 3) + 1]::BIGINT AS waited_ms,
  CASE WHEN event_id % 5 < 3 THEN 'completed' ELSE 'dead_letter' END AS state,
  CASE event_id % 5 WHEN 3 THEN 'status 503' WHEN 4 THEN 'ConnectionError: refused' ELSE '' END AS error,
  event_id % 5 >= 3 AS is_dead FROM messages""")
def run_flow_retries(spark, folder):
    """Messages to an HTTP endpoint that options describe; what it refuses goes through the retry table to its end."""
    register_source("events", lambda session, options: m.messages(session, options["folder"]))
    home, start = shared_dir(spark, "retries"), F.lit("2024-01-31 00:00:00").cast("timestamp")
    config = {
        "source": {"type": "events", "options": {"folder": folder}}, "steps": [{"kind": "validate"}], "default": "endpoint",
        "sinks": {"endpoint": {"type": "http", "options": {
            "url": "https://partner.example/in", "method": "PUT", "timeout": 5, "headers": {"X-Origin": "flow"},
            "body": "envelope", "opener": _endpoint}}},
        "retry_dir": f"{home}/retry", "retry": {"max_failures": 3}}
    plans.run_flow(spark, config, as_of=start)
    states = plans.drain_flow(spark, config, wait=lambda moment: F.lit(moment).cast("timestamp"), dead_dir=f"{home}/dead")
    passes = plans.retry_log(spark, f"{home}/retry").groupBy("id").agg(F.count(F.lit(1)).alias("passes"))
    dead = spark.read.parquet(f"{home}/dead").select("id", F.lit(True).alias("is_dead"))
    return states.join(passes, "id").join(dead, "id", "left").select(
        "id", F.col("failures").cast("bigint").alias("failures"), "passes", "waited_ms", "state",
        F.coalesce("error", F.lit("")).alias("error"), F.coalesce("is_dead", F.lit(False)).alias("is_dead"))


@query("registered_connectors", """
SELECT o_orderkey AS order_id, o_orderpriority AS priority FROM orders""")
def registered_connectors(spark, folder):
    """Orders out through a registered sink and back in through registered sources."""
    from ..sources.registry import open_source, send_to
    path = shared_dir(spark, "bus")
    env = m.order_payloads(spark, folder)
    send_to(env, "nats", {"path": path, "subject": "orders.new"})
    back = open_source(spark, "nats", {"path": path, "topic": "orders.*"})
    document = F.from_json(F.col("payload").cast("string"), "order_id bigint, priority string")
    return back.select(document.alias("d")).select("d.order_id", "d.priority")


@query("poll_folder", f"""
WITH {m.FILES} SELECT doc_id, CASE extension WHEN 'json' THEN 'skip' ELSE 'process' END AS action,
  CASE extension WHEN 'json' THEN '' ELSE sha256(content) END AS checksum FROM files""")
def poll_folder(spark, folder):
    """A second poll over a folder of which a first one has taken some files."""
    landing, home = _landed(spark, folder), shared_dir(spark, "polls")
    as_of = F.lit("2100-01-01 00:00:00").cast("timestamp")
    for number, pattern in enumerate(["*.json", "*"]):
        report = plans.poll_folder(
            spark, landing, lambda env: env.write.parquet(f"{home}/sent{number}"), f"{home}/state",
            as_of=as_of + F.expr(f"INTERVAL {number} HOURS"), pattern=pattern, stage_dir=f"{home}/stage{number}")
    sent = spark.read.parquet(f"{home}/sent1").select("id", F.sha2("payload", 256).alias("checksum"))
    staged = spark.read.parquet(f"{home}/stage1").select("id", "name")
    named = sent.join(staged, "id").select("name", "checksum")
    return report.join(named, "name", "left").select(
        F.regexp_extract("name", r"^([0-9]+)", 1).cast("bigint").alias("doc_id"), "action",
        F.coalesce("checksum", F.lit("")).alias("checksum"))
