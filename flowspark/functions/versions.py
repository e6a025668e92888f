"""Semantic versions as comparable columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def version_key(version: Column) -> Column:
    """A version as a value that Spark orders as semantic versions are: three numbers (missing ones are 0), releases
    after their pre-releases, and identifiers of a pre-release one by one, numbers before words. Build metadata does
    not count; what is no version is NULL."""
    core = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    digits = F.transform(F.regexp_extract_all(core, F.lit(r"(\d+)"), 1), lambda part: part.try_cast("bigint"))
    padded = F.when(F.size(digits) < 3, F.slice(
        F.concat(digits, F.array_repeat(F.lit(0).cast("bigint"), 3)), 1, 3)).otherwise(digits)
    before = F.regexp_extract(version, r"^v?[\d.]+-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(F.array_remove(F.split(before, r"\."), ""), lambda part: F.struct(
        part.rlike(r"^\d+$").eqNullSafe(False).alias("word"), part.try_cast("bigint").alias("number"), part.alias("text")))
    return F.when(core != "", F.struct(padded.alias("core"), (before == "").alias("release"), parts.alias("before")))


def in_range(version: Column, allowed: str) -> Column:
    """Whether ``version`` satisfies a list such as ``>=1.0.0,<2.0.0`` or a pattern such as ``1.%``."""
    if "%" in allowed:
        return version.like(allowed)
    key = version_key(version)
    tests = {
        ">=": key.__ge__, "<=": key.__le__, ">": key.__gt__, "<": key.__lt__, "=": key.__eq__, "==": key.__eq__,
    }
    condition = F.lit(True)
    for clause in allowed.split(","):
        found = re.fullmatch(r"\s*(>=|<=|==|=|>|<)?\s*(v?\d[\d.]*(?:-[0-9A-Za-z.-]+)?)\s*", clause)
        if found is None:
            raise ValueError(f"bad version range: {allowed}")
        condition = condition & tests[found[1] or "="](version_key(F.lit(found[2])))
    return condition
