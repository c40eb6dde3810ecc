"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, extraction, history, ingest, similarity  # noqa: F401
from .base import ORACLES, QUERIES, run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
