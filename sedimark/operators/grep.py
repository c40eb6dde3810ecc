"""Search in bodies: texts first, then the functions that have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import at_commit, with_overlay


def grep_bodies(functions: DataFrame, content: DataFrame, pattern: str, path: str | None = None, case_sensitive: bool = True) -> DataFrame:
    """Functions whose body matches, with the body; ``path`` restricts files, whatever the case.

    Each distinct body is searched once; metadata is filtered by path before the join.
    """
    hits = content.where(F.col("content").rlike(pattern if case_sensitive else "(?i)" + pattern)).select(F.col("hash").alias("body_hash"), F.col("content").alias("body"))
    rows = functions if path is None else functions.where(F.col("file_path").rlike("(?i)" + path))
    return rows.drop("body").join(hits, "body_hash")


def grep_bodies_at(functions: DataFrame, content: DataFrame, manifest: DataFrame, pattern: str, overlay: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    found = grep_bodies(at_commit(functions, manifest), content, pattern)
    return found if overlay is None else with_overlay(found, overlay.where(F.col("body").rlike("(?i)" + pattern)), touched)


def matching_lines(functions: DataFrame, pattern: str) -> DataFrame:
    """(name, file_path, line, content): every line of a body that matches, numbered in its file."""
    lines = functions.where(F.col("body").rlike(pattern)).select("name", "file_path", "line_start", F.posexplode(F.split("body", "\n", -1)).alias("pos", "content"))
    return lines.where(F.col("content").rlike(pattern)).select("name", "file_path", (F.col("line_start") + F.col("pos")).alias("line"), "content")
