"""The built-in source and sink types. Everything they read has been landed by something else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks, sources
from ..operators import bus_to_envelopes, files_to_envelopes, match_subject, new_envelope, requests_to_envelopes
from ..schema import MAX_PAYLOAD_BYTES
from ..session import shared_dir
from ..sources.registry import register_sink, register_source


def _required(options: dict, *names: str) -> list:
    missing = [name for name in names if not options.get(name)]
    if missing:
        raise ValueError(f"missing option: {', '.join(missing)}")
    return [options[name] for name in names]


def _file_source(spark: SparkSession, options: dict) -> DataFrame:
    [folder] = _required(options, "path")
    return files_to_envelopes(sources.read_files(spark, folder, options.get("pattern", "*"))).drop(
        "path", "modificationTime")


def _http_source(spark: SparkSession, options: dict) -> DataFrame:
    [folder] = _required(options, "path")
    schema = "id string, body binary, headers map<string,string>, remote_addr string, received_at timestamp"
    return requests_to_envelopes(spark.read.schema(schema).format(options.get("format", "parquet")).load(folder))


def _bus_source(spark: SparkSession, options: dict) -> DataFrame:
    [folder] = _required(options, "path")
    records = spark.read.schema("subject string, value string, ts timestamp").format(
        options.get("format", "json")).load(folder)
    return bus_to_envelopes(match_subject(records, options.get("topic", ">"))).drop("subject")


def _envelope_source(spark: SparkSession, options: dict) -> DataFrame:
    [folder] = _required(options, "path")
    return spark.read.format(options.get("format", "parquet")).load(folder)


def _csv_source(spark: SparkSession, options: dict) -> DataFrame:
    folder, schema = _required(options, "path", "schema")
    rows = sources.read_csv_records(spark, folder, schema)
    body = F.to_json(F.struct(*rows.columns)).cast("binary")
    return new_envelope(rows.select(
        body.alias("payload"), F.lit("application/json").alias("content_type"), F.lit("csv").alias("source")))


def _place(options: dict, folder: str) -> str:
    """Where a sink writes: in a stream each micro-batch has a folder of its own, which a repeat replaces."""
    return folder if options.get("batch") is None else f"{folder.rstrip('/')}/batch={options['batch']}"


def _file_sink(env: DataFrame, options: dict) -> None:
    [folder] = _required(options, "path")
    plan = sinks.plan_file_output(env, options.get("filename", "{{.ID}}.{{.Extension}}"),
                                  organize_by=options.get("organize_by", "none"),
                                  max_size=options.get("max_size", MAX_PAYLOAD_BYTES))
    # In a stream the batch names the write, so that a batch that is repeated replaces what it left.
    batch = options.get("batch")
    sinks.write_files_committed(plan, folder, job=None if batch is None else f"batch-{batch}")


def _http_sink(env: DataFrame, options: dict) -> DataFrame:
    """Sends to the endpoint that ``url``, ``method``, ``timeout``, ``retries`` and ``headers`` describe, or by a given ``send``;
    returns the delivery report."""
    report = options.get("report_path") or shared_dir(env.sparkSession, "deliveries")
    if options.get("send"):
        settings = {name: options[name] for name in ("send", "attempts", "headers") if name in options}
    else:
        settings = sinks.http_options(options)
    settings |= {name: options[name] for name in ("backoff", "body", "concurrency") if name in options}
    return sinks.deliver(env, report_path=_place(options, report), **settings)


def _bus_sink(env: DataFrame, options: dict) -> None:
    folder, subject = _required(options, "path", "subject")
    records = sinks.to_bus_records(env, subject, options.get("stage"))
    records.write.mode(options.get("mode", "overwrite")).format(options.get("format", "json")).save(
        _place(options, folder))


def _envelope_sink(env: DataFrame, options: dict) -> None:
    [folder] = _required(options, "path")
    env.write.mode(options.get("mode", "overwrite")).format(options.get("format", "parquet")).save(
        _place(options, folder))


def register_builtin() -> None:
    register_source("file", _file_source)
    register_source("http", _http_source)
    register_source("nats", _bus_source)
    register_source("csv", _csv_source)
    register_source("envelopes", _envelope_source)
    register_sink("file", _file_sink)
    register_sink("http", _http_sink)
    register_sink("nats", _bus_sink)
    register_sink("envelopes", _envelope_sink)
