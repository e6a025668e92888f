"""Operators for training-data pipelines. Nothing else of the library imports this folder."""

from .queries import ORACLES, QUERIES  # noqa: F401
