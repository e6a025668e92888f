"""Making, merging and reshaping envelope frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import append_step as step_appended, client_ip, content_type_of, envelope_from_json, unpacked
from ..functions.envelopes import header
from ..schema import DEFAULT_TTL, ENVELOPE_COLUMNS


def new_envelope(
    df: DataFrame, *, created_at: Column | None = None, ttl: str = DEFAULT_TTL, id: Column | None = None
) -> DataFrame:
    """Completes ``df`` to an envelope frame; columns it already has keep their values.

    A generated id changes whenever the plan is computed again. Give ``id`` where the source has one, or
    write the result before reading it twice.
    """
    created = created_at if created_at is not None else F.current_timestamp()
    payload = F.col("payload") if "payload" in df.columns else F.lit(None).cast("binary")
    defaults = {
        "id": id if id is not None else F.uuid(),
        "tenant_id": F.lit(""),
        "integration_id": F.lit(""),
        "payload": payload,
        "payload_ref": F.lit(None).cast("string"),
        "payload_size": F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint"),
        "content_type": F.lit(""),
        "source": F.lit(""),
        "current_step": F.lit(0),
        "step_history": F.array().cast("array<string>"),
        "created_at": created,
        "expires_at": created + F.expr(f"INTERVAL {ttl}"),
        "retry_count": F.lit(0),
        "last_error": F.lit(None).cast("string"),
    }
    others = [name for name in df.columns if name not in defaults]
    return df.select(
        *[F.col(name) if name in df.columns else value.alias(name) for name, value in defaults.items()], *others)


def append_step(env: DataFrame, step: str | Column) -> DataFrame:
    return env.withColumns({
        "step_history": step_appended(F.col("step_history"), F.lit(step) if isinstance(step, str) else step),
        "current_step": F.coalesce("current_step", F.lit(0)) + 1,
    })


def files_to_envelopes(
    files: DataFrame, *, id: Column | None = None, created_at: Column | None = None, ttl: str = DEFAULT_TTL
) -> DataFrame:
    """Rows of a file listing (path, modificationTime, length, content) as messages; an ``id`` is kept."""
    landed = files.select(
        *[name for name in files.columns if name == "id"],
        F.col("content").alias("payload"),
        F.col("length").alias("payload_size"),
        content_type_of(F.col("path")).alias("content_type"),
        F.lit("FileConsumer").alias("source"),
        "path", "modificationTime",
    )
    return new_envelope(landed, id=id, created_at=created_at, ttl=ttl)


def requests_to_envelopes(requests: DataFrame, *, id: Column | None = None, ttl: str = DEFAULT_TTL) -> DataFrame:
    """Landed webhook requests (body, headers, remote_addr, received_at) as messages."""
    landed = requests.withColumns({
        "payload": F.col("body").cast("binary"),
        "content_type": F.coalesce(header(F.col("headers"), "Content-Type"), F.lit("application/json")),
        "source": F.lit("http"),
        "step_history": F.array(F.concat(F.lit("http-input:"), client_ip(F.col("headers"), F.col("remote_addr")))),
    })
    made = new_envelope(landed, created_at=F.col("received_at"), id=id, ttl=ttl)
    return made.drop("body", "headers", "remote_addr", "received_at")


def bus_to_envelopes(records: DataFrame, *, id: Column | None = None, ttl: str = DEFAULT_TTL) -> DataFrame:
    """Bus records (subject, value, ts) as messages.

    A value that is an envelope in JSON is decoded once and keeps its identity; any other value becomes
    the payload of a new message.
    """
    step = F.concat(F.lit("nats-input:"), F.col("subject"))
    opened = records.select("*", unpacked(
        envelope_from_json(F.col("value")), [f"__{name}" for name in ENVELOPE_COLUMNS]))
    inner = {name: F.col(f"__{name}") for name in ENVELOPE_COLUMNS}
    payload = F.col("value").cast("binary")
    nested = F.coalesce(inner["id"], F.lit("")) != ""
    fresh = {
        "id": id if id is not None else F.uuid(),
        "tenant_id": F.lit(""),
        "integration_id": F.lit(""),
        "payload": payload,
        "payload_ref": F.lit(None).cast("string"),
        "payload_size": F.octet_length(payload).cast("bigint"),
        "content_type": F.lit("application/octet-stream"),
        "source": F.lit("nats"),
        "current_step": F.lit(0),
        "step_history": F.array(step),
        "created_at": F.col("ts").cast("timestamp"),
        "expires_at": F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {ttl}"),
        "retry_count": F.lit(0),
        "last_error": F.lit(None).cast("string"),
    }
    kept = dict(inner)
    kept["payload_size"] = F.coalesce(F.octet_length(inner["payload"]).cast("bigint"), inner["payload_size"])
    kept["step_history"] = step_appended(inner["step_history"], step)
    return opened.select(
        "subject", *[F.when(nested, kept[name]).otherwise(fresh[name]).alias(name) for name in ENVELOPE_COLUMNS])


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Several sources as one flow; columns a source lacks are NULL."""
    merged, *rest = frames
    for frame in rest:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged
