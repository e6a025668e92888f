"""Registered queries over the test tables, with the SQL that must give the same rows."""

from . import (  # noqa: F401
    catalog, changes, converters, files, filters, flows, messages, metrics, retention, state, streams, text,
)
from .registry import ORACLES, QUERIES  # noqa: F401
