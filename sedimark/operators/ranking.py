"""Picks of one row among several of a name, as windows with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def body() -> Column:
    return F.coalesce(F.col("body"), F.lit(""))


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark prunes to one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _ties() -> list[Column]:
    return [F.col("file_path"), F.col("git_file_hash"), F.col("line_start")]


def best_definition(functions: DataFrame, ties: tuple[str, ...] = ("line_end", "n_params")) -> DataFrame:
    """By name: rows of .c files first, then real bodies that span lines, then with parameters, then the longest body.

    ``ties`` tell apart rows of one place.
    """
    real = (F.col("line_end") > F.col("line_start")) & (F.octet_length(body()) > 50)
    order = [F.col("file_path").endswith(".c").desc(), real.desc(), (F.col("n_params") > 0).desc(), F.octet_length(body()).desc(), *_ties(), *ties]
    return top_one(functions, ["name"], order)


def best_by_extent(functions: DataFrame) -> DataFrame:
    """By name, from metadata alone: rows outside headers first, then the longest extent."""
    return top_one(functions, ["name"], [F.col("file_path").endswith(".h"), (F.col("line_end") - F.col("line_start")).desc(), *_ties()])


def best_overlay(functions: DataFrame) -> DataFrame:
    """By name, among files of the working directory: .c first, then the longest body."""
    return top_one(functions, ["name"], [F.col("file_path").endswith(".c").desc(), F.octet_length(body()).desc(), *_ties()])


def implementations(functions: DataFrame) -> DataFrame:
    """Macros, and functions with more than a declaration for a body."""
    one_line = (F.col("line_end") - F.col("line_start") <= 1) & F.trim(body()).endswith(";")
    return functions.where((F.col("return_type") == "") | ((F.octet_length(body()) > 50) & ~one_line))


def is_definition() -> Column:
    text = F.trim(body())
    braces = text.contains("{") & text.contains("}")
    return (
        F.when(text == "", False)
        .when(F.col("return_type") == "", True)
        .when(text.endswith(";") & ~text.contains("{"), False)
        .when(braces, True)
        .when(F.col("file_path").rlike(r"\.(h|hpp)$"), False)
        .otherwise(~text.endswith(";"))
    )


def dedup_in_file(functions: DataFrame) -> DataFrame:
    """One row per file and name: with body and parameters first, then longer extent, longer body, more parameters."""
    full = (F.octet_length(body()) > 0) & (F.col("n_params") > 0)
    return top_one(functions, ["file_path", "git_file_hash", "name"], [full.desc(), (F.col("line_end") - F.col("line_start")).desc(), F.octet_length(body()).desc(), F.col("n_params").desc(), F.col("line_start")])


def dedup_types_in_file(types: DataFrame) -> DataFrame:
    """One row per file, name and kind: more members first, then the longer definition."""
    return top_one(types, ["file_path", "git_file_hash", "name", "kind"], [F.col("n_fields").desc(), F.octet_length("definition").desc(), F.col("line")])


def last_wins(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of the rows of a batch that share a key, the one that came last."""
    return top_one(df, keys, [F.col(sequence).desc()])
