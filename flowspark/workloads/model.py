"""The tables seen as messages, files, logs, changes and catalog; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import new_envelope

AS_OF_TEXT = "2024-01-31 00:00:00"
LOG_AS_OF_TEXT = "1998-06-01 00:00:00"


def at(text: str = AS_OF_TEXT) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stamp(moment: Column | str) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as envelopes, with ``event_id`` and ``value`` beside them."""
    events = table(spark, folder, "events")
    landed = events.select(
        F.concat(F.lit("msg-"), "event_id").alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"),
        F.concat(F.lit("i"), F.col("user_id") % 20).alias("integration_id"),
        F.col("props").cast("binary").alias("payload"),
        F.lit("application/json").alias("content_type"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("created_at"),
        "event_id", "user_id", "value")
    return new_envelope(landed, created_at=F.col("created_at"))


MESSAGES = """messages AS (
  SELECT event_id, user_id, value, 'msg-' || event_id AS id, 't' || (user_id % 5) AS tenant_id,
         'i' || (user_id % 20) AS integration_id, props AS payload, strlen(props) AS payload_size,
         event_type AS source, ts AS created_at, ts + INTERVAL 15 MINUTE AS expires_at
  FROM events)"""


def state_log(spark: SparkSession, folder: str) -> DataFrame:
    """Five arrivals per message; errors are failures."""
    return table(spark, folder, "events").select(
        (F.col("event_id") % 2000).alias("message_id"), F.col("event_id").alias("seq"), "ts",
        status_of(F.col("event_type")).alias("status"))


def status_of(event_type: Column) -> Column:
    return (F.when(event_type == "signup", "received").when(event_type == "view", "processing")
            .when(event_type == "error", "retry").otherwise("completed"))


STATE_LOG = """log AS (
  SELECT event_id % 2000 AS message_id, event_id AS seq, ts,
         CASE event_type WHEN 'signup' THEN 'received' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'retry'
                         ELSE 'completed' END AS status
  FROM events)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a file listing."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix_of(F.col("lang")))
        .alias("path"),
        F.timestamp_add("SECOND", F.col("doc_id") % 86400, at()).alias("modificationTime"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.col("text").cast("binary").alias("content"), "doc_id")


def suffix_of(lang: Column) -> Column:
    return F.when(lang == "en", ".json").when(lang == "fr", ".csv").when(lang == "de", ".xml").otherwise("")


FILES = """files AS (
  SELECT doc_id, '/in/' || source || '/' || doc_id ||
           CASE lang WHEN 'en' THEN '.json' WHEN 'fr' THEN '.csv' WHEN 'de' THEN '.xml' ELSE '' END AS path,
         TIMESTAMP '2024-01-31 00:00:00' + to_seconds(doc_id % 86400) AS modified,
         strlen(text) AS length, text AS content,
         CASE lang WHEN 'en' THEN 'application/json' WHEN 'fr' THEN 'text/csv' WHEN 'de' THEN 'application/xml'
                   ELSE 'application/octet-stream' END AS content_type,
         CASE lang WHEN 'en' THEN 'json' WHEN 'fr' THEN 'csv' WHEN 'de' THEN 'xml' ELSE 'bin' END AS extension
  FROM documents)"""


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as changes of accounts, which are keyed by user."""
    events = table(spark, folder, "events")
    event_type, value = F.col("event_type"), F.col("value").cast("string")
    image = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("value"), value)
    op = F.when(event_type == "signup", "I").when(event_type == "error", "D").otherwise("U")
    return events.select(
        F.col("event_id").alias("lsn"),
        F.floor(F.col("event_id") / 7).alias("txid"),
        "ts", op.alias("op"),
        F.lit("public").alias("schema"),
        F.concat(F.lit("accounts_"), F.col("user_id") % 4).alias("table"),
        F.when(op != "I", image).alias("before"),
        F.when(op != "D", image).alias("after"),
        "user_id", "value")


CHANGES = """changes AS (
  SELECT event_id AS lsn, event_id // 7 AS txid, ts, user_id, value, 'accounts_' || (user_id % 4) AS table_name,
         CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op
  FROM events)"""


def tenants(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as tenants."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 7 == 0, "suspended").when(F.col("c_custkey") % 11 == 0, "deleted")
        .otherwise("active").alias("status"),
        (F.col("c_custkey") % 10 + 5).alias("max_integrations"),
        (F.col("c_custkey") % 40 + 10).alias("max_messages_per_month"))


TENANTS = """tenants AS (
  SELECT c_custkey AS id, c_name AS name,
         CASE WHEN c_custkey % 7 = 0 THEN 'suspended' WHEN c_custkey % 11 = 0 THEN 'deleted' ELSE 'active' END AS status,
         c_custkey % 10 + 5 AS max_integrations, c_custkey % 40 + 10 AS max_messages_per_month
  FROM customer)"""


def connectors(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as connectors."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


def integrations(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as integrations; some have no producer, some no bus instance."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("tenant_id"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "paused")
        .otherwise("draft").alias("status"),
        (key % 250).alias("consumer_id"),
        F.when(key % 4 != 0, key % 300).alias("producer_id"),
        F.when(key % 3 == 0, key % 10).alias("instance_id"),
        F.col("o_orderdate").alias("created_at"))


INTEGRATIONS = """integrations AS (
  SELECT o_orderkey AS id, o_custkey AS tenant_id,
         CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'paused' ELSE 'draft' END AS status,
         o_orderkey % 250 AS consumer_id,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 300 END AS producer_id,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 END AS instance_id,
         o_orderdate AS created_at
  FROM orders)"""


def message_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as the log of finished and unfinished messages."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("integration_id"), F.col("l_linenumber").alias("line"),
        F.when(flag == "A", "completed").when(flag == "N", "retry").otherwise("dead_letter").alias("status"),
        F.when(F.col("l_orderkey") % 9 != 0, F.col("l_shipdate")).alias("completed_at"),
        F.col("l_shipdate").alias("created_at"),
        F.round(F.col("l_quantity")).cast("bigint").alias("payload_size"))


MESSAGE_LOG = """log AS (
  SELECT l_orderkey AS integration_id, l_linenumber AS line,
         CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'retry' ELSE 'dead_letter' END AS status,
         CASE WHEN l_orderkey % 9 <> 0 THEN l_shipdate END AS completed_at, l_shipdate AS created_at,
         CAST(round(l_quantity) AS BIGINT) AS payload_size
  FROM lineitem)"""


def order_payloads(spark: SparkSession, folder: str) -> DataFrame:
    from ..plans.orders import order_messages
    return order_messages(table(spark, folder, "orders"))


ORDER_PAYLOADS = """payloads AS (
  SELECT o_orderkey, o_custkey, 'order-' || o_orderkey AS id, 't' || (o_custkey % 5) AS tenant_id,
         '{"order_id":' || o_orderkey || ',"amount":' || o_totalprice || ',"status":"' || o_orderstatus ||
           '","priority":"' || o_orderpriority || '"}' AS payload,
         o_totalprice, o_orderstatus, o_orderpriority, o_orderdate
  FROM orders)"""
