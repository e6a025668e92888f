"""Streams run over all input there is; their SQL is that of the batch twin."""

from pyspark.sql import functions as F

from .. import operators as op, sinks, sources, streaming
from ..session import shared_dir
from . import changes as changes_module, model as m
from .registry import query
from .state import LOCKS_SQL, RETRY_SQL


MICRO_BATCH = 1 << 30


def event_stream(spark, folder, *, timers=False):
    """The events table as a stream, in a session of its own."""
    session = streaming.stream_session(spark, spark.sparkContext.defaultParallelism, timers=timers)
    schema = m.table(session, folder, "events").schema
    # A glob, because a stream reads folders and globs but no single file. The size of a micro-batch is
    # bounded, and with it what the hottest key brings to its task at once.
    return (session.readStream.schema(schema).option("maxBytesPerTrigger", MICRO_BATCH)
            .parquet(f"{folder.rstrip('/')}/events.parque[t]"))


def places(spark, purpose):
    home = shared_dir(spark, purpose)
    return f"{home}/out", f"{home}/checkpoint"


def back(spark, written, path):
    """The result of a stream, read by the caller's session."""
    return spark.read.schema(written.schema).parquet(path)


@query("stream_files", f"""
WITH {m.FILES}, landed AS (SELECT doc_id, content_type, CASE WHEN doc_id % 10 = 3 THEN '' ELSE content END AS content FROM files)
SELECT doc_id, 1 AS version, content_type, strlen(content) AS payload_size, sha256(content) AS checksum FROM landed
UNION ALL SELECT doc_id, 2, content_type, strlen(content || '!'), sha256(content || '!') FROM landed WHERE doc_id % 6 = 2""")
def stream_files(spark, folder):
    """Files that come in four batches, some of them empty; a fifth batch brings new versions of some. Each comes once."""
    landing, (path, checkpoint) = shared_dir(spark, "watched"), places(spark, "stream-files")
    session, state = streaming.stream_session(spark, timers=False), shared_dir(spark, "listings")
    files = m.files(spark, folder).withColumn("content", F.when(F.col("doc_id") % 10 == 3, F.lit(b"")).otherwise(F.col("content")))
    parts = [(files.filter(F.col("doc_id") % 4 == k), 1) for k in range(4)]
    parts.append((files.filter(F.col("doc_id") % 6 == 2).withColumn("content", F.concat("content", F.lit(b"!"))), 2))
    for part, version in parts:
        name = F.substring_index("path", "/", -1)
        sinks.write_files(part.select(
            F.col("doc_id").cast("string").alias("id"), name.alias("rel_path"), F.col("content").alias("payload"),
            F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("string").alias("reject_reason")),
            landing, report_dir=f"{landing}-report-{len(parts)}")
        found = sources.stream_files(session, landing, state_dir=state, shares=3, settle=0)
        env = op.files_to_envelopes(found).select(
            F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).cast("bigint").alias("doc_id"), F.lit(version).alias("version"),
            "content_type", "payload_size", F.sha2("payload", 256).alias("checksum"))
        streaming.run_to_table(env, path, checkpoint)
    return back(spark, env, path)


@query("message_rate_stream", f"""
SELECT 't' || user_id % 5 AS tenant_id, {m.sql_stamp('time_bucket(INTERVAL 5 MINUTE, ts)')} AS window_start,
  count(*) AS messages, round(count(*) / 300.0, 9) AS per_second FROM events GROUP BY 1, 2""")
def message_rate_stream(spark, folder):
    env = event_stream(spark, folder).select(
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("created_at"))
    rates = op.message_rate(env.withWatermark("created_at", "10 minutes"))
    path, checkpoint = places(spark, "rates")
    return back(spark, streaming.run_complete(rates, path, checkpoint), path).select(
        "tenant_id", m.stamp("window_start").alias("window_start"), "messages",
        F.round("per_second", 9).alias("per_second"))


# Events come in five micro-batches by their time; ``late`` of them one batch later than that.
ARRIVALS = """bounds AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
arriving AS (SELECT events.*, least(4, 5 * (epoch_us(ts) - low) // (high - low + 1) + CASE WHEN {late} THEN 1 ELSE 0 END) AS arrival
  FROM events, bounds)"""


def _in_batches(spark, folder, late, run):
    """``run`` a stream of the events over each of five arrivals."""
    home, events = shared_dir(spark, "arrivals"), m.table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    arrival = F.least(F.lit(4), F.floor(5 * (us - low) / (high - low + 1)) + late.cast("int"))
    arriving = events.withColumn("arrival", arrival)
    session = streaming.stream_session(spark, timers=False)
    for number in range(5):
        arriving.filter(F.col("arrival") == number).drop("arrival").coalesce(1).write.mode("append").parquet(f"{home}/feed")
        run(session.readStream.schema(events.schema).parquet(f"{home}/feed"), f"{home}/state", f"{home}/checkpoint").awaitTermination()
    return f"{home}/state"


@query("message_rate_windows", f"""
WITH {ARRIVALS.format(late="event_id % 10 = 3")},
marks AS (SELECT a.arrival, max(b.ts) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT arrival FROM arriving) a
  LEFT JOIN arriving b ON b.arrival < a.arrival GROUP BY 1),
judged AS (SELECT 't' || user_id % 5 AS tenant_id, time_bucket(INTERVAL 5 MINUTE, ts) AS start,
    coalesce(time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= mark, false) AS late FROM arriving JOIN marks USING (arrival))
SELECT tenant_id, {m.sql_stamp('start')} AS window_start, count(*) FILTER (NOT late) AS messages, count(*) FILTER (late) AS late
FROM judged GROUP BY tenant_id, start""")
def message_rate_windows(spark, folder):
    """Windows that close as the stream goes on, each given out once, and the rows that came too late for theirs."""
    def run(stream, root, checkpoint):
        env = stream.select(F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"),
                            F.col("ts").cast("timestamp").alias("created_at"))
        return streaming.rate_stream(env, root, checkpoint, availableNow=True)

    root = _in_batches(spark, folder, F.col("event_id") % 10 == 3, run)
    end = spark.createDataFrame([], "tenant_id string, created_at timestamp")
    streaming.rate_batch(end, root, 1000, flush=True)
    late = streaming.read_batches(spark, root, "late").groupBy(
        "tenant_id", F.window("created_at", "5 minutes")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("late"))
    closed = streaming.read_batches(spark, root).select("tenant_id", "window_start", "messages")
    return closed.join(late, ["tenant_id", "window_start"], "full").select(
        "tenant_id", m.stamp("window_start").alias("window_start"),
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in ("messages", "late")])


@query("rate_limit_flag_stream", """
SELECT event_id, user_id % 3 AS key, n AS request_number, n > 1 AS over_limit FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id % 3, date_trunc('minute', ts) ORDER BY ts, event_id)
    AS n FROM events)""")
def rate_limit_flag_stream(spark, folder):
    """Each request is flagged in the batch that it comes in; the same as the batch operator says of all."""
    def run(stream, root, checkpoint):
        requests = stream.select("event_id", (F.col("user_id") % 3).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
        return streaming.flag_stream(requests, root, checkpoint, limit=1, order=["ts", "event_id"], availableNow=True)

    root = _in_batches(spark, folder, F.lit(False), run)
    return streaming.read_batches(spark, root).select("event_id", "key", "request_number", "over_limit")


@query("track_messages", RETRY_SQL + " FROM known")
def track_messages(spark, folder):
    arrivals = event_stream(spark, folder).select(
        (F.col("event_id") % 2000).alias("message_id"), F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("failed"))
    tracked = streaming.track_messages(arrivals, order=["seq"])
    path, checkpoint = places(spark, "states")
    return back(spark, streaming.run_to_table(tracked, path, checkpoint), path).select(
        "message_id", "seq", "outcome", "retry_count")


@query("track_files", """
WITH arrivals AS (SELECT event_id, user_id AS name, sha256(event_type) AS version FROM events),
marked AS (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY event_id) AS earlier FROM arrivals)
SELECT event_id, name, CASE WHEN earlier = version THEN 'skip' ELSE 'process' END AS action FROM marked""")
def track_files(spark, folder):
    arrivals = event_stream(spark, folder).select(
        F.col("user_id").alias("name"), "event_id", F.sha2("event_type", 256).alias("head_sha256"),
        F.lit(0).cast("bigint").alias("mtime_s"), F.lit(False).alias("failed"),
        F.col("event_id").alias("seen_ms"))
    tracked = streaming.track_files(arrivals, order=["event_id"])
    path, checkpoint = places(spark, "file-states")
    return back(spark, streaming.run_to_table(tracked, path, checkpoint), path).select("event_id", "name", "action")


@query("dedupe_message_stream", LOCKS_SQL)
def dedupe_message_stream(spark, folder):
    arrivals = event_stream(spark, folder).select(F.col("user_id").alias("id"), "ts")
    opened = streaming.dedupe_message_stream(arrivals, ttl_seconds=12 * 3600)
    path, checkpoint = places(spark, "locks")
    return back(spark, streaming.run_to_table(opened, path, checkpoint), path).select("id", m.stamp("ts").alias("ts"))


@query("schedule_retries", """
SELECT 'msg-' || event_id AS id, (event_id % 5 + 1)::INTEGER AS attempts,
  CASE WHEN event_id % 5 + 1 > 3 THEN 'give_up' ELSE 'release' END AS action FROM events WHERE event_type = 'error'""")
def schedule_retries(spark, folder):
    failures = event_stream(spark, folder, timers=True).filter(F.col("event_type") == "error").select(
        F.concat(F.lit("msg-"), "event_id").alias("id"), (F.col("event_id") % 5 + 1).cast("int").alias("attempts"))
    expected = m.table(spark, folder, "events").filter(F.col("event_type") == "error").count()
    path, checkpoint = places(spark, "retries")
    released = streaming.run_until(
        streaming.schedule_retries(failures, base_ms=50), path, checkpoint, expected)
    return back(spark, released, path)


@query("batch_transactions", f"""
WITH {m.CHANGES}
SELECT txid, row_number() OVER (PARTITION BY txid ORDER BY lsn) AS position, lsn, op AS row,
  bool_or(lsn % 7 = 6) OVER (PARTITION BY txid) AS complete
FROM changes""")
def batch_transactions(spark, folder):
    """All changes come back; a transaction whose end has not come is given out when its time is over."""
    event_type = F.col("event_type")
    held = event_stream(spark, folder, timers=True).select(
        F.floor(F.col("event_id") / 7).alias("txid"), F.col("event_id").alias("lsn"),
        F.when(event_type == "signup", "I").when(event_type == "error", "D").otherwise("U").alias("row"),
        (F.col("event_id") % 7 == 6).alias("is_last"))
    path, checkpoint = places(spark, "transactions")
    emitted = streaming.run_until(streaming.batch_transactions(held), path, checkpoint,
                                  m.table(spark, folder, "events").count())
    return streaming.ordered_transactions(back(spark, emitted, path))


INTERLEAVED = "event_id % 5 + 5 * (event_id // 35)"


@query("order_transaction_stream", f"""
WITH changes AS (SELECT event_id AS lsn, {INTERLEAVED} AS txid FROM events)
SELECT lsn, txid, row_number() OVER (ORDER BY lsn) AS position, bool_or(lsn % 35 >= 30) OVER (PARTITION BY txid) AS complete
FROM changes""")
def order_transaction_stream(spark, folder):
    """Interleaved transactions of seven changes that come in five micro-batches, a tenth of them a batch late."""
    home = shared_dir(spark, "ordered")
    events, lsn = m.table(spark, folder, "events"), F.col("event_id")
    total = events.agg(F.max("event_id")).first()[0] + 1
    block = -(-total // 4)
    feed = events.select(
        lsn.alias("lsn"), (lsn % 5 + 5 * F.floor(lsn / 35)).alias("txid"), F.timestamp_seconds(lsn).alias("ts"),
        (lsn % 35 >= 30).alias("is_last"), (F.floor(lsn / block) + (lsn % 10 == 3).cast("int")).alias("arrival"))
    streaming_session = streaming.stream_session(spark, timers=False)
    schema = feed.drop("arrival").schema
    for arrival in range(5):
        feed.filter(F.col("arrival") == arrival).drop("arrival").coalesce(1).write.mode("append").parquet(f"{home}/feed")
        changes = streaming_session.readStream.schema(schema).parquet(f"{home}/feed")
        streaming.order_stream(changes, f"{home}/log", f"{home}/checkpoint", hold_seconds=2.0 * block, open_seconds=4.0 * block,
                               availableNow=True).awaitTermination()
    streaming.flush_order(spark, f"{home}/log", batch=1000)
    given = streaming.read_ordered(spark, f"{home}/log")
    # The place of each change among all that left the stream, in the order in which they did.
    ranked = op.ordered_scan(given.withColumn("all", F.lit(0)), ["all"], ["batch", "lsn"], rank="position")
    return ranked.select("lsn", "txid", F.col("position").cast("bigint").alias("position"), "complete")


@query("apply_change_stream", changes_module.APPLIED_SQL)
def apply_change_stream(spark, folder):
    event_type = F.col("event_type")
    feed = event_stream(spark, folder).select(
        F.col("event_id").alias("lsn"), "user_id", "value",
        F.when(event_type == "signup", "I").when(event_type == "error", "D").otherwise("U").alias("op"))
    accounts = m.table(feed.sparkSession, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    root, checkpoint = places(spark, "replica")
    run = streaming.apply_change_stream(feed, accounts, root, ["user_id"], checkpoint, availableNow=True)
    run.awaitTermination()
    base = m.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return streaming.read_replica(spark, base, feed, root, ["user_id"])
