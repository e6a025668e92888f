"""Sources and sinks that touch storage. Each run uses a fresh folder in the shared space."""

from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import payload_checksum
from ..session import shared_dir
from . import model as m
from .registry import query


def _landed(spark, folder) -> str:
    """Documents as files of one folder."""
    landing = shared_dir(spark, "landing")
    name = F.substring_index("path", "/", -1)
    sinks.write_files(m.files(spark, folder).select(
        F.col("doc_id").cast("string").alias("id"), name.alias("rel_path"), F.col("content").alias("payload"),
        payload_checksum(F.col("content")).alias("checksum"), F.lit(None).cast("string").alias("reject_reason")),
        landing)
    return landing


@query("read_files", f"""
WITH {m.FILES} SELECT doc_id || '.json' AS name, length, sha256(content) AS checksum FROM files
WHERE extension = 'json'""")
def read_files(spark, folder):
    files = sources.read_files(spark, _landed(spark, folder), "*.json")
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length",
                        payload_checksum(F.col("content")).alias("checksum"))


@query("plan_file_output", f"""
WITH {m.FILES} SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'empty_id' WHEN length > 9000 THEN 'payload_too_large' ELSE ''
    END AS reject_reason,
  CASE WHEN doc_id % 9 = 0 OR length > 9000 THEN '' ELSE strftime(modified, '%Y/%m/%d') || '/out-' || doc_id || '.' ||
    extension END AS rel_path,
  CASE WHEN doc_id % 9 = 0 OR length > 9000 THEN '' ELSE sha256(content) END AS checksum FROM files""")
def plan_file_output(spark, folder):
    from ..operators import files_to_envelopes
    listing = m.files(spark, folder).withColumn("modificationTime", F.col("modificationTime"))
    name = F.regexp_extract("path", r"([^/.]+)(\.[^/]*)?$", 1).cast("bigint")
    env = files_to_envelopes(listing, created_at=F.col("modificationTime"), id=F.lit("")).withColumn("doc_id", name)
    env = env.withColumn("id", F.when(name % 9 == 0, "").otherwise(name.cast("string")))
    plan = sinks.plan_file_output(env, "out-{{.ID}}.{{.Extension}}", organize_by="date", max_size=9000)
    return plan.select("doc_id", *[
        F.coalesce(column, F.lit("")).alias(column) for column in ("reject_reason", "rel_path", "checksum")])


@query("write_files", f"""
WITH {m.FILES} SELECT replace(content_type, '/', '-') || '/' || doc_id || '.' || extension AS key, length,
  sha256(content) AS checksum, sha256(content) AS reported FROM files""")
def write_files(spark, folder):
    files = m.files(spark, folder)
    env = files.select(
        F.col("doc_id").cast("string").alias("id"), F.col("content").alias("payload"), F.lit("").alias("source"),
        F.col("modificationTime").alias("created_at"), _mime().alias("content_type"))
    out = shared_dir(spark, "files")
    report = sinks.write_files(sinks.plan_file_output(env, organize_by="type"), out)
    found = sources.read_objects(spark, out, "*").select(
        "key", "length", payload_checksum(F.col("content")).alias("checksum"))
    return found.join(report.select(F.col("rel_path").alias("key"), F.col("checksum").alias("reported")), "key")


@query("write_files_committed", f"""
WITH {m.FILES} SELECT replace(content_type, '/', '-') || '/' || doc_id || '.' || extension AS key, length,
  sha256(content) AS checksum, sha256(content) AS reported FROM files WHERE length <= 9000""")
def write_files_committed(spark, folder):
    """Files by a committing writer; what is found below the folder is what was committed, and nothing else."""
    files = m.files(spark, folder)
    env = files.select(
        F.col("doc_id").cast("string").alias("id"), F.col("content").alias("payload"), F.lit("").alias("source"),
        F.col("modificationTime").alias("created_at"), _mime().alias("content_type"))
    out = shared_dir(spark, "committed")
    report = sinks.write_files_committed(sinks.plan_file_output(env, organize_by="type", max_size=9000), out,
                                         report_dir=shared_dir(spark, "committed-report"))
    found = sources.read_objects(spark, out, "*").select(
        "key", "length", payload_checksum(F.col("content")).alias("checksum"))
    return found.join(report.select(F.col("rel_path").alias("key"), F.col("checksum").alias("reported")), "key", "left")


def _mime():
    from ..functions import content_type_of
    return content_type_of(F.col("path"))


@query("settle_files", f"""
WITH {m.FILES} SELECT path_name AS name, action, 1::BIGINT AS found FROM (
  SELECT split_part(path, '/', -1) AS path_name, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'archived' END AS action
  FROM files)""")
def settle_files(spark, folder):
    landing, home = _landed(spark, folder), shared_dir(spark, "settled")
    listed = sources.read_files(spark, landing).select("path").withColumn(
        "error", F.when(F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).cast("bigint") % 5 == 0, "unreadable"))
    report = sinks.settle_files(
        listed, as_of=m.at(), archive_dir=f"{home}/archive", error_dir=f"{home}/error", report_dir=f"{home}/_report")
    moved = sources.read_objects(spark, home, "*").select("key").filter(~F.endswith("key", F.lit(".error")))
    name = F.substring_index("key", "/", -1)
    by_place = moved.groupBy(name.alias("name"), F.substring_index("key", "/", 1).alias("place")).agg(
        F.count(F.lit(1)).alias("found"))
    stated = report.select(F.substring_index("path", "/", -1).alias("name"), "action")
    return stated.join(by_place.filter(F.col("place").isin("archive", "error")), "name").select(
        "name", "action", "found")


@query("offload_payloads", """
SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 't' || doc_id % 5 || '/messages/' || doc_id || '.bin' ELSE '' END AS key,
  strlen(text) AS payload_size, strlen(text) <= 4096 AS inline FROM documents""")
def offload_payloads(spark, folder):
    env = sinks.offload_payloads(_papers(spark, folder), shared_dir(spark, "objects"), threshold=4096)
    key = F.regexp_extract("payload_ref", r"([^/]+/messages/[^/]+)$", 1)
    return env.select(F.col("id").cast("bigint").alias("doc_id"), F.coalesce(key, F.lit("")).alias("key"),
                      "payload_size", F.col("payload").isNotNull().alias("inline"))


def _papers(spark, folder):
    from ..operators import new_envelope
    papers = m.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("doc_id") % 5).alias("tenant_id"),
        F.col("text").cast("binary").alias("payload"), F.col("source").alias("source"))
    return new_envelope(papers, created_at=m.at())


@query("resolve_payload_refs", """
SELECT doc_id, sha256(text) AS checksum, strlen(text) AS payload_size, true AS inline FROM documents""")
def resolve_payload_refs(spark, folder):
    store = shared_dir(spark, "objects")
    light = sinks.offload_payloads(_papers(spark, folder), store, threshold=4096)
    env = sinks.resolve_payload_refs(light, store)
    return env.select(F.col("id").cast("bigint").alias("doc_id"), payload_checksum().alias("checksum"),
                      "payload_size", F.col("payload_ref").isNull().alias("inline"))


@query("read_csv_records", """
SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders""")
def read_csv_records(spark, folder):
    path = shared_dir(spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    m.table(spark, folder, "orders").select(*columns).write.mode("overwrite").option("header", True).csv(path)
    rows = sources.read_csv_records(
        spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice decimal(12,2), o_orderpriority string")
    return rows.select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
                       "o_orderpriority")


@query("read_changes", f"""
WITH {m.CHANGES} SELECT lsn, txid, op, table_name, CASE WHEN op <> 'D' THEN value::VARCHAR END AS after_value,
  {m.sql_stamp('ts')} AS ts FROM changes""")
def read_changes(spark, folder):
    path = shared_dir(spark, "feed")
    landed = m.changes(spark, folder).drop("user_id", "value")
    spelled = F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "UPDATE").otherwise("d")
    landed.withColumns({"op": spelled, "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}).write.mode(
        "overwrite").json(path)
    feed = sources.read_changes(spark, path)
    return feed.select("lsn", "txid", "op", F.col("table").alias("table_name"),
                       F.col("after")["value"].alias("after_value"), m.stamp("ts").alias("ts"))


@query("write_archive", """
SELECT strftime(ts, '%Y-%m-%d') AS archive_date, count(*) AS messages, sum(strlen(props))::BIGINT AS total_bytes
FROM events GROUP BY 1""")
def write_archive(spark, folder):
    path = shared_dir(spark, "archive")
    sinks.write_archive(m.messages(spark, folder), path, processed_at=F.col("created_at"))
    return spark.read.parquet(path).groupBy(F.col("archive_date").cast("string").alias("archive_date")).agg(
        F.count(F.lit(1)).alias("messages"), F.sum("payload_size").alias("total_bytes"))


@query("write_errors", """
SELECT strftime(ts, '%Y-%m-%d') AS error_date, 'failed at ' || user_id % 3 AS error, count(*) AS messages
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def write_errors(spark, folder):
    path = shared_dir(spark, "errors")
    failed = m.messages(spark, folder).filter(F.col("source") == "error")
    sinks.write_errors(failed, path, failed_at=F.col("created_at"),
                       error=F.concat(F.lit("failed at "), F.col("user_id") % 3))
    return spark.read.parquet(path).groupBy(F.col("error_date").cast("string").alias("error_date"), "error").agg(
        F.count(F.lit(1)).alias("messages"))


@query("write_dead_letter", """
SELECT strftime(ts, '%Y-%m-%d') AS dead_date, 'gave up: ' || event_type AS last_error, count(*) AS messages
FROM events WHERE event_type = 'error' GROUP BY ALL""")
def write_dead_letter(spark, folder):
    path = shared_dir(spark, "dead")
    failed = m.messages(spark, folder).filter(F.col("source") == "error")
    sinks.write_dead_letter(failed, path, dead_at=F.col("created_at"),
                            reason=F.concat(F.lit("gave up: "), "source"))
    return spark.read.parquet(path).groupBy(F.col("dead_date").cast("string").alias("dead_date"), "last_error").agg(
        F.count(F.lit(1)).alias("messages"))


class FlakyEndpoint:
    """Answers by message number alone: 0 accepts, 1 accepts the second try, 2 fails, 3 raises."""

    def __init__(self):
        self.tries = {}

    def __call__(self, body, headers):
        message = headers["X-Message-ID"]
        kind = int(message.split("-")[1]) % 4
        self.tries[message] = self.tries.get(message, 0) + 1
        if kind == 3:
            raise ConnectionError("refused")
        return {0: 202, 1: 503 if self.tries[message] == 1 else 200, 2: 500}[kind]


@query("deliver", f"""
WITH {m.MESSAGES} SELECT id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts,
  CASE event_id % 4 WHEN 0 THEN 202 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE -1 END AS status, event_id % 4 < 2 AS delivered,
  CASE event_id % 4 WHEN 2 THEN 'status 500' WHEN 3 THEN 'ConnectionError: refused' ELSE '' END AS error FROM messages""")
def deliver(spark, folder):
    report = sinks.deliver(m.messages(spark, folder), FlakyEndpoint(), shared_dir(spark, "report"), backoff=0.0)
    return report.select("id", "attempts", F.coalesce("status", F.lit(-1)).alias("status"), "delivered",
                         F.coalesce("error", F.lit("")).alias("error"))
