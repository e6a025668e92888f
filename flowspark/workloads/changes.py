"""Change data capture."""

from pyspark.sql import functions as F

from .. import operators as op, sinks
from ..session import shared_dir
from ..sinks import write_table
from . import model as m
from .registry import query


def _accounts(spark, folder):
    return m.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))


APPLIED_SQL = f"""
WITH {m.CHANGES}, latest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM changes) WHERE n = 1)
SELECT c_custkey AS user_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM latest)
UNION ALL SELECT user_id, value FROM latest WHERE op <> 'D'"""


@query("apply_changes", APPLIED_SQL)
def apply_changes(spark, folder):
    return op.apply_changes(_accounts(spark, folder), m.changes(spark, folder), ["user_id"])


def _incoming(spark, folder):
    """Balances of every third account and of accounts not there yet."""
    known = _accounts(spark, folder).filter(F.col("user_id") % 3 == 0)
    return known.select("user_id", (-F.col("value")).alias("value")).unionByName(
        m.table(spark, folder, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("user_id"),
                                                  F.col("s_acctbal").alias("value")))


INCOMING = """old AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer),
fresh AS (SELECT user_id, -value AS value FROM old WHERE user_id % 3 = 0
  UNION ALL SELECT s_suppkey + 10000000, s_acctbal FROM supplier)"""


@query("write_table_upsert", f"""
WITH {INCOMING} SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def upsert(spark, folder):
    return write_table(_accounts(spark, folder), _incoming(spark, folder), ["user_id"], shared_dir(spark, "table"))


@query("write_table_insert", f"""
WITH {INCOMING} SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE user_id NOT IN (SELECT user_id FROM old)""")
def insert(spark, folder):
    return write_table(_accounts(spark, folder), _incoming(spark, folder), ["user_id"], shared_dir(spark, "table"),
                       strategy="insert", on_conflict="skip")


@query("write_table_update", f"""
WITH {INCOMING} SELECT o.user_id, coalesce(f.value, o.value) AS value FROM old o LEFT JOIN fresh f USING (user_id)""")
def update(spark, folder):
    return write_table(_accounts(spark, folder), _incoming(spark, folder), ["user_id"], shared_dir(spark, "table"),
                       strategy="update", on_conflict="skip")


@query("write_table_conflicts", f"""
WITH {INCOMING} SELECT 'insert' AS strategy, user_id FROM fresh WHERE user_id IN (SELECT user_id FROM old)
UNION ALL SELECT 'update', user_id FROM fresh WHERE user_id NOT IN (SELECT user_id FROM old)""")
def conflicts(spark, folder):
    found = [op.merge_rows(_accounts(spark, folder), _incoming(spark, folder), ["user_id"], strategy)[1]
             .select(F.lit(strategy).alias("strategy"), "user_id") for strategy in ("insert", "update")]
    return op.merge_sources(*found)


@query("write_keyed_upsert", f"""
WITH {INCOMING}, merged AS (SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT 'after' AS version, user_id, value FROM merged UNION ALL SELECT 'before', user_id, value FROM old""")
def write_keyed_upsert(spark, folder):
    """A keyed table in buckets before and after an upsert, read side by side."""
    path, accounts = shared_dir(spark, "keyed"), _accounts(spark, folder)
    sinks.create_keyed(path, accounts.schema, ["user_id"], buckets=16)
    first, _ = sinks.write_keyed(accounts, path, strategy="insert")
    sinks.write_keyed(_incoming(spark, folder), path)
    return sinks.read_keyed(spark, path).withColumn("version", F.lit("after")).unionByName(
        sinks.read_keyed(spark, path, first.version).withColumn("version", F.lit("before"))).select("version", "user_id", "value")


@query("write_keyed_few_keys", """
SELECT c_custkey AS user_id, CASE WHEN c_custkey % 100 = 7 THEN c_acctbal + 1 ELSE c_acctbal END AS value, true AS only_theirs
FROM customer""")
def write_keyed_few_keys(spark, folder):
    """An update of one key in a hundred; ``only_theirs``: other buckets' files are the ones of the version before."""
    path, accounts = shared_dir(spark, "keyed"), _accounts(spark, folder)
    sinks.create_keyed(path, accounts.schema, ["user_id"], buckets=256)
    before, _ = sinks.write_keyed(accounts, path, strategy="insert")
    some = accounts.filter(F.col("user_id") % 100 == 7).withColumn("value", F.col("value") + 1)
    after, touched = sinks.write_keyed(some, path, strategy="update")
    same = all(after.held[bucket] == write for bucket, write in before.held.items() if bucket not in touched)
    rewritten = all(after.held[bucket] == after.version for bucket in touched)
    return sinks.read_keyed(spark, path).withColumn("only_theirs", F.lit(same and rewritten and len(touched) <= some.count()))


@query("apply_changes_batches", APPLIED_SQL)
def apply_changes_batches(spark, folder):
    """Changes in five batches that overlap and come out of order, one of them twice, into a replica in buckets."""
    path = shared_dir(spark, "replica")
    sinks.create_replica(path, _accounts(spark, folder).schema, ["user_id"], buckets=32)
    sinks.load_replica(_accounts(spark, folder), path, lsn=-1)
    changes = m.changes(spark, folder).select("lsn", "op", "user_id", "value")
    for batch, part in enumerate([3, 1, 1, 0, 4, 2]):
        late = F.col("lsn") % 5 == part
        again = (F.col("lsn") % 5 == (part + 1) % 5) & (F.col("lsn") % 3 == 0)  # delivered in another batch too
        sinks.apply_to_replica(changes.filter(late | again), path, batch)
    sinks.apply_to_replica(changes.filter("lsn % 5 = 3"), path, 0)  # a batch that is repeated
    return sinks.read_replica_table(spark, path)


@query("batch_number", f"""
WITH {m.CHANGES} SELECT lsn, op, (row_number() OVER (PARTITION BY op ORDER BY lsn) - 1) // 100 AS batch FROM changes""")
def batch_number(spark, folder):
    return op.batch_number(m.changes(spark, folder).select("lsn", "op")).select("lsn", "op", "batch")


@query("group_by_operation", f"""
WITH {m.CHANGES}, numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY op ORDER BY lsn) - 1) // 100 AS batch FROM changes)
SELECT op, batch, count(*) AS n_rows, min(lsn) AS first_lsn, string_agg(user_id::VARCHAR, ',' ORDER BY lsn) AS keys
FROM numbered GROUP BY op, batch""")
def group_by_operation(spark, folder):
    grouped = op.group_by_operation(
        m.changes(spark, folder).select("lsn", "op", "user_id"), F.col("user_id").cast("string"))
    rows = F.col("rows")
    return grouped.select("op", "batch", "n_rows", F.get(rows, 0)["lsn"].alias("first_lsn"),
                          F.array_join(F.transform(rows, lambda r: r["row"]), ",").alias("keys"))


@query("group_transactions", f"""
WITH {m.CHANGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY lsn // 500 ORDER BY lsn) - 1 AS n,
  lsn // 500 AS big_txid, count(*) OVER (PARTITION BY lsn // 500) AS n_changes FROM changes)
SELECT big_txid AS txid, n // 200 AS part, ceil(n_changes / 200.0)::BIGINT AS n_parts, n_changes, min(lsn) AS first_lsn,
  max(lsn) AS last_lsn, string_agg(op, '' ORDER BY lsn) AS ops FROM ranked GROUP BY ALL""")
def group_transactions(spark, folder):
    long_ones = m.changes(spark, folder).select("lsn", F.floor(F.col("lsn") / 500).alias("txid"), "op")
    grouped = op.group_transactions(long_ones, F.col("op"), max_rows=200)
    return grouped.select("txid", "part", "n_parts", "n_changes", "first_lsn", "last_lsn",
                          F.array_join(F.transform("changes", lambda c: c["row"]), "").alias("ops"))


@query("change_images", f"""
WITH {m.CHANGES}, images AS (SELECT lsn, user_id, op, CASE WHEN op <> 'D' THEN value END AS after_value FROM changes)
SELECT lsn, user_id, op, coalesce(lag(after_value) OVER (PARTITION BY user_id ORDER BY lsn), -1) AS before_value,
  coalesce(after_value, -1) AS after_value FROM images""")
def change_images(spark, folder):
    images = op.change_images(m.changes(spark, folder).select("lsn", "user_id", "op", "value"), ["user_id"], "value")
    return images.select("lsn", "user_id", "op", *[
        F.coalesce(name, F.lit(-1.0)).alias(name) for name in ("before_value", "after_value")])
