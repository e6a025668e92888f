"""Change feeds and database tables as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CHANGE, CHANGE_OPERATIONS


def read_changes(spark: SparkSession, path: str, *, format: str = "json", stream: bool = False) -> DataFrame:
    """Change records of a landed feed; operations may be spelled out or abbreviated."""
    reader = spark.readStream if stream else spark.read
    changes = reader.format(format).schema(CHANGE).load(path)
    op = F.upper(F.substring("op", 1, 1))
    return changes.withColumn("op", F.when(op.isin(CHANGE_OPERATIONS), op))


def jdbc_options(
    url: str, table: str, *, column: str | None = None, lower=None, upper=None, partitions: int | None = None,
    fetch_size: int = 10_000, **properties,
) -> dict[str, str]:
    """Options of a JDBC read, split into ranges of ``column`` so that no single task reads the table."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs lower, upper and partitions")
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_table_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Snapshot of a database table; filters and columns are pushed into the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()
