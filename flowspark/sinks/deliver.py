"""Deliveries to an endpoint and to a bus."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import envelope_to_json

Send = Callable[[bytes, dict[str, str]], int]

REPORT = "id string, attempts int, status int, delivered boolean, error string"


def deliver(
    env: DataFrame, send: Send, report_path: str, *, attempts: int = 3, backoff: float = 1.0,
    headers: dict[str, str] | None = None, body: str = "payload", concurrency: int = 8,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Sends every message by ``send(body, headers) -> status`` and returns the delivery report.

    2xx is success; anything else is tried again, up to ``attempts`` tries, waiting ``backoff`` seconds,
    then twice as long each time. Runs at once and writes the report to ``report_path``, so that reading it
    does not send again. A lost task sends its messages again under the same ``X-Message-ID``.
    ``body="envelope"`` sends the whole envelope as JSON.
    """
    content = envelope_to_json().cast("binary") if body == "envelope" else F.col("payload")
    mime = F.lit("application/json") if body == "envelope" else F.coalesce(
        F.nullif("content_type", F.lit("")), F.lit("text/plain"))
    rows = env.select("id", content.alias("body"), mime.alias("mime"))
    extra = headers or {}

    def attempt(message: tuple[str, bytes, str]) -> dict:
        message_id, payload, content_type = message
        sent_headers = {"Content-Type": content_type, **extra, "X-Message-ID": message_id}
        status, error, tries = None, None, 0
        for tries in range(1, attempts + 1):
            try:
                status, error = int(send(bytes(payload or b""), sent_headers)), None
                if 200 <= status < 300:
                    break
                error = f"status {status}"
            except Exception as failure:  # any failure of the endpoint is a failed try
                status, error = None, f"{type(failure).__name__}: {failure}"
            if tries < attempts:
                wait(backoff * 2 ** (tries - 1))
        return {"id": message_id, "attempts": tries, "status": status, "delivered": error is None and tries > 0,
                "error": error}

    def send_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                messages = list(batch[["id", "body", "mime"]].itertuples(index=False, name=None))
                shares = [messages[start::concurrency] for start in range(concurrency)]
                report = [line for lines in pool.map(lambda share: list(map(attempt, share)), shares) for line in lines]
                yield pd.DataFrame(report, columns=["id", "attempts", "status", "delivered", "error"]).astype(
                    {"status": "Int32"})

    rows.mapInPandas(send_all, REPORT).write.mode("overwrite").parquet(report_path)
    return env.sparkSession.read.schema(REPORT).parquet(report_path)


def to_bus_records(env: DataFrame, subject: str | Column, stage: str | None = None) -> DataFrame:
    """Rows (key, subject, value) for a bus; a stage publishes under its own derived subject."""
    base = F.lit(subject) if isinstance(subject, str) else subject
    return env.select(
        F.col("id").alias("key"),
        (F.concat_ws(".", base, F.lit(stage)) if stage else base).alias("subject"),
        envelope_to_json().alias("value"))
