"""State of messages and files from their logs."""

from pyspark.sql import functions as F

from .. import operators as op
from . import model as m
from .registry import query

RETRY_SQL = f"""
WITH {m.STATE_LOG}, counted AS (
  SELECT *, sum(CASE WHEN status = 'retry' THEN 1 ELSE 0 END) OVER (PARTITION BY message_id ORDER BY seq) AS failures
  FROM log), known AS (SELECT *, failures - CASE WHEN status = 'retry' THEN 1 ELSE 0 END AS earlier FROM counted)
SELECT message_id, seq, CASE WHEN earlier >= 3 THEN 'dead_letter' WHEN status = 'retry' THEN 'retry' ELSE 'completed' END
  AS outcome, least(CASE WHEN earlier >= 3 THEN earlier ELSE failures END, 3)::INTEGER AS retry_count"""


@query("latest_state", f"""
WITH {m.STATE_LOG} SELECT message_id, seq, status FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, seq DESC) AS n FROM log) WHERE n = 1""")
def latest_state(spark, folder):
    return op.latest_state(m.state_log(spark, folder), ["message_id"], ["ts", "seq"]).select(
        "message_id", "seq", "status")


@query("retry_history", RETRY_SQL + f""", CASE WHEN earlier < 3 AND status = 'retry' THEN
  {m.sql_stamp('ts + to_seconds((1 << earlier::INT)::BIGINT)')} ELSE '' END AS next_attempt_at FROM known""")
def retry_history(spark, folder):
    history = op.retry_history(m.state_log(spark, folder), order=["seq"], failed=F.col("status") == "retry")
    return history.select("message_id", "seq", "outcome", "retry_count",
                          F.coalesce(m.stamp("next_attempt_at"), F.lit("")).alias("next_attempt_at"))


@query("dedupe_files", """
WITH arrivals AS (SELECT doc_id, source AS name, sha256(lang) AS version, n_chars % 2 AS mtime FROM documents),
marked AS (SELECT *, lag(version || mtime) OVER (PARTITION BY name ORDER BY doc_id) AS earlier FROM arrivals)
SELECT doc_id, name, earlier IS NULL OR earlier <> version || mtime AS is_new FROM marked""")
def dedupe_files(spark, folder):
    arrivals = m.table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("name"), F.sha2("lang", 256).alias("version"),
        (F.col("n_chars") % 2).alias("mtime"))
    marked = op.dedupe_files(arrivals, version=["version", "mtime"], order=["doc_id"], keep_all=True)
    return marked.select("doc_id", "name", "is_new")


LOCKS_SQL = f"""
WITH RECURSIVE arrivals AS (SELECT user_id AS id, ts FROM events),
opened AS (
  SELECT id, min(ts) AS ts FROM arrivals GROUP BY id
  UNION ALL
  SELECT o.id, (SELECT min(a.ts) FROM arrivals a WHERE a.id = o.id AND a.ts >= o.ts + INTERVAL 12 HOUR)
  FROM opened o WHERE o.ts IS NOT NULL)
SELECT id, {m.sql_stamp('ts')} AS ts FROM opened WHERE ts IS NOT NULL"""


@query("dedupe_messages", LOCKS_SQL)
def dedupe_messages(spark, folder):
    arrivals = m.table(spark, folder, "events").select(F.col("user_id").alias("id"), "ts")
    return op.dedupe_messages(arrivals, ttl_seconds=12 * 3600).select("id", m.stamp("ts").alias("ts"))


@query("mark_duplicates", f"""
WITH opened AS ({LOCKS_SQL}),
ranked AS (SELECT event_id, user_id AS id, event_type, {m.sql_stamp('ts')} AS ts,
  row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS same FROM events)
SELECT event_id, r.id, event_type, r.ts, r.same = 1 AND opened.id IS NOT NULL AS handled
FROM ranked r LEFT JOIN opened ON opened.id = r.id AND opened.ts = r.ts""")
def mark_duplicates(spark, folder):
    """All arrivals with their columns; which ones are handled and which are duplicates under a lock."""
    arrivals = m.table(spark, folder, "events").select("event_id", F.col("user_id").alias("id"), "event_type", "ts")
    marked = op.mark_duplicates(arrivals, order=["event_id"], ttl_seconds=12 * 3600)
    return marked.select("event_id", "id", "event_type", m.stamp("ts").alias("ts"), "handled")
