"""Exponential backoff."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MAX_SHIFT = 20
MAX_BACKOFF_MS = 5 * 60 * 1000


def backoff_ms(base: Column, attempts: Column, cap: int = MAX_BACKOFF_MS) -> Column:
    """Wait after ``attempts`` failures: doubles from ``base``, never above ``cap``."""
    doublings = F.least(F.greatest(attempts.cast("int") - 1, F.lit(0)), F.lit(MAX_SHIFT))
    # Wide enough for the largest base doubled MAX_SHIFT times.
    wait = F.greatest(base, F.lit(0)).cast("decimal(19,0)") * F.pow(F.lit(2), doublings).cast("decimal(10,0)")
    return F.least(wait, F.lit(cap)).cast("bigint")


def backoff_policy_ms(
    attempts: Column, *, initial_ms: int = 1000, multiplier: float = 2.0, max_ms: int = 30_000
) -> Column:
    """Wait before retry number ``attempts`` (1, 2, ...) under a connection's retry policy."""
    grown = F.lit(float(initial_ms)) * F.pow(F.lit(float(multiplier)), attempts - 1)
    return F.least(grown, F.lit(float(max_ms))).cast("bigint")
