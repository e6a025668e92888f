"""Aggregates for statistics, quality, quotas and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import exact_quantiles, ordered_scan

DEAD_LETTER_ALARM = 10_000


def integration_stats(log: DataFrame, *, failed: Column | None = None) -> DataFrame:
    bad = failed if failed is not None else F.col("status").isin("retry", "dead_letter")
    return log.groupBy("integration_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(bad).alias("error_count"),
        F.max("created_at").alias("last_run_at"))


def delivery_quality(
    reports: DataFrame, keys: list[str], *, delivered: str = "delivered", latency: str = "latency_ms",
    exact: bool = True, slices: int | None = None,
) -> DataFrame:
    """Success rate and latency p50, p95, p99 per key; approximate quantiles need one pass less."""
    probabilities = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rates = [F.count(F.lit(1)).alias("messages"),
             F.avg(F.col(delivered).cast("double")).alias("success_rate")]
    if not exact:
        return reports.groupBy(*keys).agg(*rates, *[
            F.percentile_approx(latency, p).alias(name) for name, p in probabilities.items()])
    located = exact_quantiles(reports, keys, latency, list(probabilities.values()), slices)
    wide = located.groupBy(*keys).agg(*[
        F.max(F.when(F.col("probability") == p, F.col(latency))).alias(name) for name, p in probabilities.items()])
    # Both sides have one row per key: a union and a second aggregation spare a join, NULL keys included.
    parts = reports.groupBy(*keys).agg(*rates).unionByName(wide, allowMissingColumns=True)
    return parts.groupBy(*keys).agg(*[
        F.max(name).alias(name) for name in ("messages", "success_rate", *probabilities)])


def bucket_totals(df: DataFrame, by: list[str], size: str = "payload_size") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(size).alias("total_bytes"), F.avg(size).alias("avg_bytes"))


def status_counts(log: DataFrame, alarm_above: int = DEAD_LETTER_ALARM) -> DataFrame:
    """Messages by status; ``alarm`` is set when there are too many dead letters."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("messages")).withColumn(
        "alarm", (F.col("status") == "dead_letter") & (F.col("messages") > alarm_above))


def top_by_size(df: DataFrame, by: str, n: int, size: str = "payload_size") -> DataFrame:
    """The ``n`` largest by total bytes, ties by name."""
    return (df.groupBy(by).agg(F.sum(size).alias("total_bytes"))
            .orderBy(F.desc("total_bytes"), F.asc(by)).limit(n))


def message_rate(
    env: DataFrame, *, width: str = "5 minutes", slide: str | None = None, time: str = "created_at",
    by: str = "tenant_id",
) -> DataFrame:
    """Messages per second in event-time windows. On a stream set a watermark on ``time`` first."""
    grouped = env.groupBy(by, F.window(time, width, slide or width)).agg(F.count(F.lit(1)).alias("messages"))
    start, end = F.col("window.start"), F.col("window.end")
    seconds = F.timestamp_diff("SECOND", start, end)
    return grouped.select(by, start.alias("window_start"), end.alias("window_end"), "messages",
                          (F.col("messages") / seconds).alias("per_second"))


def sustained_rate(
    counts: DataFrame, *, as_of: Column, minutes: int = 5, by: str = "instance_id", time: str = "ts", messages: str = "messages",
) -> DataFrame:
    """``by`` and ``message_rate``: the lowest rate a second of the last whole ``minutes`` before ``as_of``.

    A minute without a row counts as 0, so the rate is above a limit only if it was so all the time.
    """
    end = F.date_trunc("minute", as_of)
    recent = counts.filter((F.col(time) < end) & (F.col(time) >= end - F.expr(f"INTERVAL {minutes} MINUTES")))
    each = recent.groupBy(by, F.date_trunc("minute", time).alias("__minute")).agg(F.sum(messages).alias("__n"))
    return each.groupBy(by).agg(
        F.when(F.count(F.lit(1)) == minutes, F.min("__n") / 60.0).otherwise(F.lit(0.0)).alias("message_rate"))


def stream_rate_limit_flags(
    requests: DataFrame, *, limit: int = 1000, key: str = "key", time: str = "ts", delay: str = "1 minute",
) -> DataFrame:
    """Requests a key and minute, and how many of them are beyond the limit, once the minute is over by ``delay``.

    For streams: the state is one count a key and open minute, so no request has to wait for another.
    """
    counted = requests.withWatermark(time, delay).groupBy(key, F.window(time, "1 minute")).agg(
        F.count(F.lit(1)).alias("requests"))
    return counted.select(key, F.col("window.start").alias("minute"), "requests",
                          F.greatest(F.col("requests") - limit, F.lit(0)).alias("beyond_limit"))


def rate_limit_flags(
    requests: DataFrame, *, limit: int = 1000, key: str = "key", time: str = "ts", order: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Numbers the requests of a key within each minute and marks those beyond the limit."""
    minutes = requests.withColumn("minute", F.date_trunc("minute", time))
    numbered = ordered_scan(minutes, [key, "minute"], order or [time], rank="request_number", slices=slices)
    return numbered.withColumn("over_limit", F.col("request_number") > limit)


def sustained_alert(
    samples: DataFrame, keys: list[str], condition: Column, *, hold: str, time: str = "ts",
    slices: int | None = None, sample_from: DataFrame | None = None,
) -> DataFrame:
    """Episodes in which ``condition`` held on every sample for at least ``hold``.

    Samples between two failing ones share the number of failures seen so far, which names the episode.
    """
    holds = F.coalesce(condition, F.lit(False))
    numbered = ordered_scan(
        samples, keys, [time], sums={"episode": (~holds).cast("bigint")}, slices=slices, sample_from=sample_from)
    span = F.expr(f"INTERVAL {hold}")
    episodes = numbered.filter(holds).groupBy(*keys, "episode").agg(
        F.min(time).alias("started_at"), F.max(time).alias("last_seen_at"), F.count(F.lit(1)).alias("samples"))
    return (episodes.filter(F.col("last_seen_at") >= F.col("started_at") + span)
            .withColumn("fired_at", F.col("started_at") + span).drop("episode"))
