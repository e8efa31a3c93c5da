"""All registered queries."""

from __future__ import annotations

from . import analysis, ingest, retrieval, serving, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
