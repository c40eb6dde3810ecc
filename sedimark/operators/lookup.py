"""Lookups by name: exact, by substring, by expression, at a commit or everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100


def at_commit(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows whose (file_path, git_file_hash) a commit's manifest has; Spark broadcasts the side that is small."""
    return rows.join(manifest.select("file_path", "git_file_hash"), ["file_path", "git_file_hash"], "left_semi")


def with_overlay(rows: DataFrame, overlay: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of files that the working directory changed or deleted give way to its own."""
    return rows.join(touched.select("file_path"), "file_path", "left_anti").unionByName(overlay, allowMissingColumns=True)


def matching(pattern: str, case_sensitive: bool, column: str = "name") -> Column:
    return F.col(column).rlike(pattern if case_sensitive else "(?i)" + pattern)


def by_regex(rows: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame:
    return rows.where(matching(pattern, case_sensitive))


def by_regex_at(rows: DataFrame, manifest: DataFrame, pattern: str, case_sensitive: bool = False, overlay: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """One pass: rows that match and that the commit has, the working directory's in the place of changed files'."""
    found = at_commit(rows.where(matching(pattern, case_sensitive)), manifest)
    return found if overlay is None else with_overlay(found, overlay.where(matching(pattern, case_sensitive)), touched)


def exact(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("name") == name)


def exact_preferring_definitions(rows: DataFrame, name: str) -> DataFrame:
    """Rows with more than 100 bytes of body over several lines; all where there is no such row."""
    defined = (F.octet_length(F.coalesce("body", F.lit(""))) > 100) & (F.col("line_end") > F.col("line_start"))
    every = Window.partitionBy("name")
    return exact(rows, name).withColumn("_d", defined).withColumn("_any", F.max("_d").over(every)).where(F.col("_d") == F.col("_any")).drop("_d", "_any")


def _tiers(rows: DataFrame, tiers: list[Column]) -> DataFrame:
    """Rows of the first tier that has any, in one plan."""
    tier = F.coalesce(*(F.when(c, i) for i, c in enumerate(tiers)))
    ranked = rows.withColumn("_tier", tier).where("_tier IS NOT NULL")
    least = ranked.agg(F.min("_tier").alias("_least"))
    return ranked.join(F.broadcast(least), F.col("_tier") == F.col("_least")).drop("_tier", "_least")  # one row


def fuzzy(rows: DataFrame, name: str, order: list[str], limit: int = LIMIT) -> DataFrame:
    """Rows of that very name; where there is none, those whose name contains it; the first ``limit`` by ``order``."""
    return _tiers(rows, [F.col("name") == name, F.col("name").contains(name)]).orderBy(*order).limit(limit)


def fuzzy_at(rows: DataFrame, manifest: DataFrame, name: str, order: list[str], limit: int = LIMIT) -> DataFrame:
    return fuzzy(at_commit(rows.where(F.col("name").contains(name)), manifest), name, order, limit)


def by_kind(types: DataFrame, kind: str, order: list[str], limit: int = LIMIT) -> DataFrame:
    return types.where(F.col("kind") == kind).orderBy(*order).limit(limit)


def by_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose name is in ``names``, one a name: the last by path, hash and line."""
    w = Window.partitionBy("name").orderBy(F.desc("file_path"), F.desc("git_file_hash"), F.desc("line_start"))
    return rows.join(names.select("name").distinct(), "name", "left_semi").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_blobs(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of those (file_path, git_file_hash)."""
    return at_commit(rows, blobs)


def through_symbols(symbol: str, symbols: DataFrame, manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Symbol to files to the commit's blobs to rows; rows from anywhere where the commit has none."""
    files = symbols.where(F.col("symbol") == symbol).select(F.col("filename").alias("file_path")).distinct()
    blobs = manifest.join(files, "file_path", "left_semi").select("file_path", "git_file_hash", F.lit(1).alias("_here"))
    return _tiers(exact(rows, symbol).join(blobs, ["file_path", "git_file_hash"], "left"), [F.col("_here").isNotNull(), F.lit(True)]).drop("_here")


def exists_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with whether ``rows`` has them."""
    have = rows.select(*on).distinct().withColumn("present", F.lit(True))
    return keys.join(have, on, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def named_or_like(rows: DataFrame, name: str, suggestions: int = 3) -> DataFrame:
    """(tier, name): the verb's answer: exact rows, else rows the name matches as an expression, else the nearest names."""
    plain = name
    for keyword in ("struct ", "union ", "enum "):
        plain = plain.removeprefix(keyword)
    found = _tiers(rows, [F.col("name") == plain, matching(plain, False)])
    near = rows.select("name").distinct().where(F.levenshtein("name", F.lit(plain)) <= max(2, len(plain) // 3)).orderBy(F.levenshtein("name", F.lit(plain)), "name").limit(suggestions)
    answers = found.select(F.when(F.col("name") == plain, 0).otherwise(1).alias("tier"), "name").distinct().unionByName(near.select(F.lit(2).alias("tier"), "name"))
    least = answers.agg(F.min("tier").alias("_least"))
    return answers.join(F.broadcast(least), F.col("tier") == F.col("_least")).drop("_least")


def lines_between(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.where((F.col("line_start") >= first) & (F.col("line_end") <= last)).withColumn("extent", F.col("line_end") - F.col("line_start"))
