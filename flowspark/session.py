"""Session settings and the few places where the library touches cluster state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. Broadcast joins are left to the planner, which compares
# the measured size of a side with autoBroadcastJoinThreshold; the library gives no broadcast hints.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Keyed streaming state lives in RocksDB so that it may outgrow executor memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "flowspark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` as Catalyst estimates it; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches that queries run in the block send to Python workers end at ``size`` bytes, or with the row that goes beyond."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_base(spark: SparkSession) -> str | None:
    """The folder all executors share, as the cluster names it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return conf or spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    It lies below ``spark.checkpoint.dir``. Only a local master, where driver and executors are
    one process, may fall back to a temporary folder of the machine.
    """
    base = shared_base(spark)
    if base:
        return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{purpose}-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(spark) or shared_dir(spark, "checkpoint"))
    return df.checkpoint()
