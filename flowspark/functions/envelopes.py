"""Columns of one message: JSON codec, checksums, history and client address."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import ENVELOPE

FINGERPRINT_BYTES = 64 * 1024


def rfc3339(moment: Column) -> Column:
    """UTC time text with the fraction cut to its significant digits."""
    text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def envelope_to_json() -> Column:
    """JSON text of the envelope columns; empty payload, reference and error are left out."""
    return F.to_json(F.struct(
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("id", "tenant_id", "integration_id")],
        F.when(F.octet_length("payload") > 0, F.col("payload")).alias("payload"),
        F.nullif(F.col("payload_ref"), F.lit("")).alias("payload_ref"),
        F.coalesce("payload_size", F.lit(0)).cast("bigint").alias("payload_size"),
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("content_type", "source")],
        F.coalesce("current_step", F.lit(0)).alias("current_step"),
        F.coalesce("step_history", F.array().cast("array<string>")).alias("step_history"),
        rfc3339(F.col("created_at")).alias("created_at"),
        rfc3339(F.col("expires_at")).alias("expires_at"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.nullif(F.col("last_error"), F.lit("")).alias("last_error"),
    ))


def envelope_from_json(text: Column) -> Column:
    """Struct of envelope columns; NULL fields where the text is not an envelope."""
    return F.from_json(text.cast("string"), ENVELOPE, {"mode": "PERMISSIVE"})


def unpacked(struct: Column, names: list[str]) -> Column:
    """The fields of a struct as columns, for use in ``select``.

    As a generator it computes the struct once, where plain field access would parse a JSON text again for
    every field.
    """
    return F.inline(F.array(struct)).alias(*names)


def payload_checksum(payload: Column | None = None) -> Column:
    return F.sha2(payload if payload is not None else F.col("payload"), 256)


def file_fingerprint(content: Column, modified: Column) -> Column:
    """What tells two versions of a file apart: hash of the head and mtime in whole seconds."""
    return F.struct(
        F.sha2(F.substring(content, 1, FINGERPRINT_BYTES), 256).alias("head_sha256"),
        F.date_trunc("second", modified).alias("mtime"),
    )


def append_step(history: Column, step: Column) -> Column:
    return F.array_append(F.coalesce(history, F.array().cast("array<string>")), step)


def header(headers: Column, name: str) -> Column:
    """Value of an HTTP header, whatever the case of its name; NULL when absent or empty."""
    entry = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.nullif(F.get(entry, 0)["value"], F.lit(""))


def client_ip(headers: Column, remote_addr: Column) -> Column:
    """Forwarded address, else real address, else the host of ``host:port``."""
    forwarded = F.regexp_replace(header(headers, "X-Forwarded-For"), " $", "")
    host = r"^(?:\[([^\[\]]*)\]|([^:\[\]]*)):[^:\[\]]*$"
    return F.coalesce(
        forwarded,
        header(headers, "X-Real-IP"),
        F.concat(F.regexp_extract(remote_addr, host, 1), F.regexp_extract(remote_addr, host, 2)),
        F.lit(""),
    )
