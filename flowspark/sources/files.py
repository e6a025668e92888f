"""Files of a folder as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import FILE_LISTING
from ..session import shared_dir
from ..sinks.storage import exists, get, listable, open_store
from .listing import FolderSource
from .registry import use


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark names it in paths of files."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _directly_in(files: DataFrame, folder: str) -> DataFrame:
    # Sub-folders are not descended into, even if their names look like partitions or repeat the folder's.
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return files.filter(parent == _qualified(files.sparkSession, folder)).select(*FILE_LISTING.fieldNames())


def list_files(spark: SparkSession, folder: str, pattern: str = "*", *, shares: int = 1, recursive: bool = False) -> DataFrame:
    """Files directly in ``folder`` as (path, modificationTime, length), listed by ``shares`` tasks; empty ones too. If
    ``recursive``, also those of sub-folders that are not hidden."""
    return spark.read.format(use(spark, FolderSource)).options(
        path=folder, prefix=_qualified(spark, folder), pattern=pattern, shares=shares, recursive=str(recursive).lower()).load()


def _content(paths: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whole files, in pieces of some ``FETCHED_BYTES``."""
    from ..sinks.files import FETCHED_BYTES
    for batch in paths:
        found, held = [], 0
        for path in batch.to_pylist():
            found.append(get(*open_store(path)))
            held += len(found[-1])
            if held >= FETCHED_BYTES:
                yield pa.array(found, pa.binary())
                found, held = [], 0
        if found:
            yield pa.array(found, pa.binary())


def _read(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame | None:
    """The files as tasks list and read them, none of the listing on the driver; None for a store that tasks do not open, or
    without the folder, which is left to Spark's reader."""
    if not listable(_qualified(spark, folder)) or not exists(*open_store(folder)):
        return None
    listed = list_files(spark, folder, pattern, shares=spark.sparkContext.defaultParallelism, recursive=recursive)
    # A column that is not selected is not worked out, so content is read only where it is.
    content = F.arrow_udf(_content, T.BinaryType())
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").withColumn("content", content("path"))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Whole files directly in ``folder`` as (path, modificationTime, length, content), empty ones too.

    Content is read only where it is selected, and the listing is filtered before. Tasks list the folder and read the files.
    Keep archives outside the folder.
    """
    found = _read(spark, folder, pattern, recursive=False)
    if found is not None:
        return found.select(*FILE_LISTING.fieldNames())
    # A recursive listing, because otherwise sub-folders are taken for partitions of a table.
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(folder))
    return _directly_in(files, folder)


def stream_files(
    spark: SparkSession, folder: str, pattern: str = "*", *, state_dir: str | None = None, shares: int = 1, tasks: int = 0,
    settle: float = 1.0,
) -> DataFrame:
    """Files as they arrive, empty ones and new versions too, each once: (path, modificationTime, length, content, error).

    Set the polling interval by the trigger of the query (5 seconds by custom). ``shares`` tasks list the folder, ``tasks`` (by
    default the shuffle partitions) read the files; a file that went meanwhile has an ``error``. ``state_dir`` belongs to one
    query, like its checkpoint: what it has seen is remembered there. Move or remove processed files by ``settle_files``.
    """
    from ..sinks.files import fetch_files
    listed = spark.readStream.format(use(spark, FolderSource)).options(
        path=folder, prefix=_qualified(spark, folder), pattern=pattern, shares=shares, settle=settle,
        state=state_dir or shared_dir(spark, "folder-listings")).load()
    spread = listed.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return fetch_files(spread)


def read_objects(spark: SparkSession, root: str, pattern: str = "*.bin") -> DataFrame:
    """Objects of a store at any depth, with ``key`` relative to the root."""
    objects = _read(spark, root, pattern, recursive=True)
    if objects is None:
        objects = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                   .option("recursiveFileLookup", "true").load(root))
    # Empty objects are passed over, as Spark's reader does.
    return objects.filter("length > 0").withColumn("key", F.substring("path", len(_qualified(spark, root)) + 2, 1 << 20))


def read_csv_records(
    spark: SparkSession, path: str, schema: str | T.StructType, *, header: bool = True, sep: str = ",",
    bad_record: str | None = None,
) -> DataFrame:
    """CSV rows by a given schema. With ``bad_record`` lines that do not fit are kept in that column."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if bad_record:
        schema = T.StructType([*schema.fields, T.StructField(bad_record, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", bad_record)
    return reader.schema(schema).csv(path)


