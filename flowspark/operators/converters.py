"""Payload conversion between JSON, XML, CSV and columns, and user-written functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import shared_dir


def _text(payload: str = "payload") -> Column:
    return F.col(payload).cast("string")


def with_payload(env: DataFrame, body: Column, content_type: str, reason: Column) -> DataFrame:
    """Replaces the payload; its size and MIME type follow. Where there is a ``reason`` against it the message stays as
    it is, and ``conversion_error`` holds the reason."""
    marked = env.withColumn("conversion_error", reason)
    fine = F.col("conversion_error").isNull()
    replaced = marked.withColumn("payload", F.when(fine, body.cast("binary")).otherwise(F.col("payload")))
    return replaced.withColumns({
        "payload_size": F.octet_length("payload").cast("bigint"),
        "content_type": F.when(fine, F.lit(content_type)).otherwise(
            F.col("content_type") if "content_type" in env.columns else F.lit(None).cast("string")),
    })


def _not_an_object(document: Column) -> Column:
    """Why a payload is no JSON object; NULL where it is one. ``document`` is the payload parsed."""
    return F.when(document.isNull(), "malformed JSON").when(~F.rlike(_text(), F.lit(r"^\s*\{")), "not a JSON object")


def _given(document: Column, path: str) -> Column:
    """Whether the document has a value other than null at ``path``."""
    value = F.try_variant_get(document, path, "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def _unconverted(checks: dict[str, Column]) -> Column:
    """The reason that names the fields whose check is true; NULL if there is none."""
    if not checks:
        return F.lit(None).cast("string")
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return F.when(F.size(names) > 0, F.concat(F.lit("fields not converted: "), F.array_join(names, ", ")))


def converted_and_failed(env: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(converted, failed)`` of a conversion; failed messages have their reason in ``last_error``."""
    bad = F.col("conversion_error").isNotNull()
    return (env.filter(~bad).drop("conversion_error"),
            env.filter(bad).withColumn("last_error", F.col("conversion_error")).drop("conversion_error"))


def map_json(env: DataFrame, mapping: dict[str, str | dict]) -> DataFrame:
    """Builds a new JSON payload, field by field.

    A field is a path (``"$.a.b"``, type kept), or a dict with one of ``path``, ``const``, ``context`` (an
    envelope column), and for a path optionally ``multiply`` and ``type``. The payload is parsed once. One that is no
    JSON object, or in which a field has another type than ``type``, stays as it is.
    """
    parsed = env.withColumn("__doc", F.try_parse_json(_text()))
    checks = {}

    def field(name: str, rule: str | dict) -> Column:
        if isinstance(rule, str):
            rule = {"path": rule}
        if "const" in rule:
            return F.lit(rule["const"])
        if "context" in rule:
            return F.col(rule["context"])
        kind = rule.get("type", "double" if "multiply" in rule else "variant")
        value = F.try_variant_get(F.col("__doc"), rule["path"], kind)
        if kind != "variant":
            checks[name] = value.isNull() & _given(F.col("__doc"), rule["path"])
        return value * F.lit(rule["multiply"]) if "multiply" in rule else value

    body = F.to_json(F.struct(*[field(name, rule).alias(name) for name, rule in mapping.items()]))
    reason = F.coalesce(_not_an_object(F.col("__doc")), _unconverted(checks))
    return with_payload(parsed, body, "application/json", reason).drop("__doc")


REST = "__rest"


def _schema(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _with_rest(schema: str | T.StructType) -> T.StructType:
    """The schema with a column for what does not follow it."""
    return T.StructType([*_schema(schema).fields, T.StructField(REST, T.StringType())])


def _no_field(row: Column, names: list[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | row[name].isNotNull()
    return ~found


def json_to_xml(env: DataFrame, schema: str | T.StructType, row_tag: str = "ROW") -> DataFrame:
    """The fields of ``schema`` as one XML element. A payload that is no JSON object, has a field that does not convert,
    or has fields but none of these, stays as it is."""
    schema = _schema(schema)
    parsed = env.withColumns({"__doc": F.try_parse_json(_text()), "__row": F.from_json(_text(), schema)})
    row, document = F.col("__row"), F.col("__doc")
    checks = {name: row[name].isNull() & _given(document, f"$['{name}']") for name in schema.names}
    # An empty object has nothing to lose; one with other fields only would lose all it has.
    foreign = _no_field(row, schema.names) & ~F.rlike(_text(), F.lit(r"^\s*\{\s*\}\s*$"))
    nothing = F.when(foreign & ~_any(F.try_variant_get(document, f"$['{name}']", "variant").isNotNull() for name in schema.names),
                     "no field of the schema")
    reason = F.coalesce(_not_an_object(document), _unconverted(checks), nothing)
    return with_payload(parsed, F.to_xml(row, {"rowTag": row_tag}), "application/xml", reason).drop("__doc", "__row")


def _any(conditions: Iterator[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def xml_to_json(env: DataFrame, schema: str | T.StructType, row_tag: str = "ROW") -> DataFrame:
    """Elements ``row_tag`` as JSON objects with the fields of ``schema``.

    One element gives an object, several give an array of objects, in order. A payload stays as it is where an element is
    malformed, has a field that does not convert, or holds content but none of the fields; and where there is no such
    element, or something outside them but the XML declaration, comments and one element around all.
    """
    whole = _with_rest(schema)
    names = [name for name in whole.names if name != REST]
    tag = re.escape(row_tag)
    element = rf"(?s)<{tag}(?:\s[^>]*)?(?:/>|(?<!/)>.*?</{tag}\s*>)"
    parsed = env.withColumn("__found", F.regexp_extract_all(_text(), F.lit(element), F.lit(0)))
    parsed = parsed.withColumn("__rows", F.transform("__found", lambda text: F.from_xml(
        text, whole, {"rowTag": row_tag, "columnNameOfCorruptRecord": REST})))
    rows = F.col("__rows")
    outside = F.regexp_replace(F.regexp_replace(_text(), element, ""), r"(?s)<\?.*?\?>|<!--.*?-->", "")
    stray = ~F.rlike(outside, F.lit(r"(?s)^\s*(?:<([^\s<>/]+)(?:\s[^<>]*)?>\s*</\1\s*>)?\s*$"))
    empty = F.lit(rf"(?s)^<{tag}(?:\s[^>]*)?(?:/>|>\s*</{tag}\s*>)$")
    foreign = F.exists(F.arrays_zip("__found", "__rows"), lambda pair: _no_field(
        pair["__rows"], names) & ~F.rlike(pair["__found"], empty))
    reason = (F.when(_text().isNull() | (F.size("__found") == 0) & (F.length(F.trim(_text())) == 0), "empty payload")
              .when(F.exists(rows, lambda row: row.isNull() | row[REST].isNotNull()) | stray, "malformed XML")
              .when(F.size("__found") == 0, F.lit(f"no element {row_tag}"))
              .when(foreign, "no field of the schema"))
    objects = F.transform(rows, lambda row: F.struct(*[row[name].alias(name) for name in names]))
    body = F.when(F.size("__found") == 1, F.to_json(F.get(objects, F.lit(0)))).otherwise(F.to_json(objects))
    return with_payload(parsed, body, "application/json", reason).drop("__found", "__rows")


def csv_to_json(env: DataFrame, schema: str, *, sep: str = ",", header: bool = False) -> DataFrame:
    """One message per CSV line of the payload; ``header`` skips the first line. A payload without lines stays one message,
    whose ``line_number`` is NULL and whose ``conversion_error`` says so."""
    lines = F.filter(F.split(_text(), r"\r?\n"), lambda line: F.length(line) > 0)
    if header:
        lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    exploded = env.select("*", F.posexplode_outer(lines).alias("line_number", "__line"))
    whole = _with_rest(schema)
    parsed = exploded.withColumn("__row", F.from_csv("__line", F.lit(whole.simpleString()[len("struct<"):-1].replace(
        ":", " ")), {"sep": sep, "columnNameOfCorruptRecord": REST}))
    body = F.to_json(F.struct(*[F.col(f"__row.`{name}`") for name in whole.names if name != REST]))
    reason = F.when(F.col("__line").isNull(), "no lines").when(
        F.col("__row").isNull() | F.col(f"__row.{REST}").isNotNull(), "malformed CSV line")
    done = with_payload(parsed, body, "application/json", reason)
    # A bad line is what its message keeps, not the whole payload again.
    own = F.when(F.col("conversion_error").isNull(), F.col("payload")).otherwise(
        F.coalesce(F.col("__line").cast("binary"), "payload"))
    return done.withColumn("payload", own).withColumn("payload_size", F.octet_length("payload").cast("bigint")).drop(
        "__line", "__row")


def convert_types(env: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Top-level JSON fields as typed columns; ``conversion_errors`` names those that did not convert."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = {field.name: f"__raw_{field.name}" for field in schema}
    parsed = env.select("*", F.json_tuple(_text(), *raw).alias(*raw.values()))

    def typed(field: T.StructField) -> Column:
        value = F.col(raw[field.name])
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.try_to_timestamp(value).cast(field.dataType)
        return value.try_cast(field.dataType)

    converted = {field.name: typed(field) for field in schema}
    errors = F.array_compact(F.array(*[
        F.when(F.col(raw[name]).isNotNull() & value.isNull(), F.lit(name)) for name, value in converted.items()]))
    return parsed.withColumns({**converted, "conversion_errors": errors}).drop(*raw.values())


def enrich(env: DataFrame, lookup: DataFrame, on: str | list[str], *, required: bool = False) -> DataFrame:
    """Adds reference values by an equi-join on unique keys of ``lookup``.

    How the join runs is left to the planner: a small lookup is broadcast by its measured size, a large
    one is shuffled, where adaptive execution splits skewed partitions of the message side.
    """
    return env.join(lookup, on, "inner" if required else "left")


def changes_to_envelopes(changes: DataFrame, *, id: Column | None = None, source: str = "cdc") -> DataFrame:
    """Change records as messages whose JSON payload holds the change and its metadata."""
    from .messages import new_envelope

    operation = (F.when(F.col("op") == "I", "INSERT").when(F.col("op") == "U", "UPDATE")
                 .when(F.col("op") == "D", "DELETE"))
    body = F.to_json(F.struct(
        operation.alias("operation"), F.col("lsn"), F.col("txid"), F.col("schema"), F.col("table"),
        F.when(F.col("op") != "I", F.col("before")).alias("before"),
        F.when(F.col("op") != "D", F.col("after")).alias("after"),
        F.map_keys(F.coalesce("after", "before")).alias("columns"),
    ))
    landed = changes.select(
        "lsn", "ts", F.col("op").alias("operation"), body.cast("binary").alias("payload"),
        F.lit("application/json").alias("content_type"), F.lit(source).alias("source"))
    made = new_envelope(landed, created_at=F.col("ts"),
                        id=id if id is not None else F.concat(F.lit("lsn-"), F.col("lsn")))
    return made.drop("ts")


def apply_converter(
    env: DataFrame, fn: Callable[[dict, dict], dict], *, config: dict | None = None, skip: str | None = None
) -> DataFrame:
    """A user function ``(message, context) -> message`` over all messages, in one pass.

    An exception fails its message only, which keeps its input, has ``failed`` set and the reason in
    ``last_error``. Messages with a true value in the column ``skip`` are not handed to the function.
    """
    schema = T.StructType([*env.schema.fields, T.StructField("failed", T.BooleanType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages, results = batch.to_pylist(), []
            for message in messages:
                if skip and message[skip]:
                    results.append({"failed": False})
                    continue
                context = {"config": config or {}, "metadata": {
                    key: message.get(key) for key in ("id", "tenant_id", "integration_id", "source")}}
                try:
                    result = dict(fn(dict(message), context))
                    if isinstance(result.get("payload"), str):
                        result["payload"] = result["payload"].encode()
                    result["payload_size"] = len(result.get("payload", message["payload"]) or b"")
                    result["failed"] = False
                except Exception as error:  # the function is the user's; any error is the message's
                    result = {"last_error": f"{type(error).__name__}: {error}", "failed": True}
                results.append(result)
            # Columns no function touched pass through as they are.
            touched = {name for result in results for name in result}
            target = batch.schema.append(pa.field("failed", pa.bool_()))
            yield pa.RecordBatch.from_arrays([
                pa.array([result.get(field.name, message.get(field.name)) for result, message in zip(results, messages)],
                         field.type) if field.name in touched else batch.column(field.name)
                for field in target], schema=target)

    return env.mapInArrow(convert, schema)


def convert_with(
    env: DataFrame, fn: Callable[[dict, dict], dict], *, config: dict | None = None, stage_dir: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(converted, failed)`` of a user function, which is run at once and once for each message: its results are written to
    ``stage_dir`` (a fresh shared folder), and both sides are read from there."""
    spark, stage = env.sparkSession, stage_dir or shared_dir(env.sparkSession, "converted")
    made = apply_converter(env, fn, config=config)
    made.write.mode("overwrite").partitionBy("failed").parquet(stage)
    done = spark.read.schema(made.schema).parquet(stage)
    return done.filter(~F.col("failed")).drop("failed"), done.filter("failed").drop("failed")


def decide_with(env: DataFrame, fn: Callable[[dict, dict], bool], *, config: dict | None = None) -> DataFrame:
    """Adds ``passes``, what a user function ``(message, context) -> pass?`` says, and ``filter_error``.

    Messages reach the function with all columns and their own types, NULL as None. An error is no pass; its text
    is in ``filter_error``.
    """
    settings = config or {}
    schema = T.StructType([*env.schema.fields, T.StructField("passes", T.BooleanType()),
                           T.StructField("filter_error", T.StringType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes, errors = [], []
            for message in batch.to_pylist():
                try:
                    passes.append(bool(fn(message, {"config": settings})))
                    errors.append(None)
                except Exception as error:  # the function is the user's; any error is the message's
                    passes.append(False)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passes, pa.bool_()), pa.array(errors, pa.string())],
                                             names=[*batch.schema.names, "passes", "filter_error"])

    return env.mapInArrow(decide, schema)


def filter_with(env: DataFrame, fn: Callable[[dict, dict], bool], *, config: dict | None = None) -> DataFrame:
    """Keeps messages a user function passes; ``decide_with`` also tells which ones failed, and why."""
    return decide_with(env, fn, config=config).filter("passes").drop("passes", "filter_error")
