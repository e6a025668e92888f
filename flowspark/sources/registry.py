"""Connectors by type name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SourceFactory = Callable[[SparkSession, dict], DataFrame]
#: A sink that delivers message by message returns its report: ``id``, ``delivered``, ``status`` and ``error``.
SinkFactory = Callable[[DataFrame, dict], DataFrame | None]

_sources: dict[str, SourceFactory] = {}
_sinks: dict[str, SinkFactory] = {}


def use(spark: SparkSession, source: type) -> str:
    """Registers a Python ``DataSource`` with a session once; returns the format to read or write it by.

    The name is the session's own: Spark looks for taken names in all sessions, but reads only what its own session knows.
    """
    known = spark.__dict__.setdefault("_flowspark_sources", {})
    if source not in known:
        name = f"{source.name()}_{uuid.uuid4().hex[:12]}"
        spark.dataSource.register(type(source.__name__, (source,), {"name": classmethod(lambda cls: name)}))
        known[source] = name
    return known[source]


def register_source(name: str, factory: SourceFactory | type) -> None:
    """Makes ``name`` a source type: a function, or a Python ``DataSource`` class."""
    if isinstance(factory, type):
        def load(spark: SparkSession, options: dict, source: type = factory) -> DataFrame:
            return spark.read.format(use(spark, source)).options(**options).load()
        _sources[name] = load
    else:
        _sources[name] = factory


def register_sink(name: str, factory: SinkFactory) -> None:
    _sinks[name] = factory


def open_source(spark: SparkSession, name: str, options: dict) -> DataFrame:
    if name not in _sources:
        raise ValueError(f"unknown source type: {name}")
    return _sources[name](spark, options)


def send_to(df: DataFrame, name: str, options: dict) -> DataFrame | None:
    if name not in _sinks:
        raise ValueError(f"unknown sink type: {name}")
    return _sinks[name](df, options)


def known_types() -> dict[str, list[str]]:
    return {"sources": sorted(_sources), "sinks": sorted(_sinks)}
