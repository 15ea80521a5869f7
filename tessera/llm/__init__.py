"""Operators and queries for training-data pipelines."""

from tessera.llm import queries  # noqa: F401  (importing registers the queries)
from tessera.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
