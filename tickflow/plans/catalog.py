"""Every query over the test tables by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from tickflow.plans import model_queries, stream_queries, table_queries  # noqa: F401
from tickflow.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
