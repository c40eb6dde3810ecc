"""Incremental ingest over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import storage
from ..streaming.ingest import branches_to_index, windowed_counts
from .base import Tables, query


@query("i01_range_blobs", "SELECT DISTINCT file_path, git_file_hash FROM {functions} f WHERE NOT EXISTS (SELECT 1 FROM {old_manifest} m WHERE m.file_path = f.file_path AND m.git_file_hash = f.git_file_hash)")
def range_blobs(t: Tables) -> DataFrame:
    blobs = t.functions.select("file_path", "git_file_hash").distinct()
    return storage.missing_keys(blobs, t.old_manifest, ["file_path", "git_file_hash"])


@query("i02_tree_blobs", "SELECT file_path, git_file_hash FROM {manifest} m WHERE NOT EXISTS (SELECT 1 FROM {old_manifest} o WHERE o.file_path = m.file_path AND o.git_file_hash = m.git_file_hash)")
def tree_blobs(t: Tables) -> DataFrame:
    return storage.missing_keys(t.manifest, t.old_manifest, ["file_path", "git_file_hash"])


@query("i04_new_mails", "SELECT message_id FROM {mails} WHERE conv_id % 3 <> 0")
def new_mails(t: Tables) -> DataFrame:
    stored = t.mails.where("conv_id % 3 = 0").select("message_id")
    return storage.missing_keys(t.mails.select("message_id").dropDuplicates(), stored, ["message_id"])


@query("i05_branches_to_index", "SELECT s_name AS branch_name, s_suppkey AS tip_commit, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey - 1 END AS since FROM {supplier} WHERE s_suppkey % 3 <> 1")
def due_branches(t: Tables) -> DataFrame:
    tips = t.supplier.select(F.col("s_name").alias("branch_name"), F.col("s_suppkey").alias("tip_commit"))
    indexed = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("branch_name"), F.expr("IF(s_suppkey % 3 = 1, s_suppkey, s_suppkey - 1)").alias("tip_commit"))
    return branches_to_index(tips, indexed)


@query("i06_overlay_manifest", "SELECT file_path, git_file_hash FROM {manifest} WHERE file_path NOT IN (SELECT file_path FROM {touched}) UNION ALL SELECT DISTINCT file_path, 'workdir' FROM {touched}")
def overlay_manifest(t: Tables) -> DataFrame:
    from ..operators.lookup import with_overlay

    return with_overlay(t.manifest, t.touched.withColumn("git_file_hash", F.lit("workdir")), t.touched)


@query("ext_windowed_events", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")
def windowed_events(t: Tables) -> DataFrame:
    return windowed_counts(t.events).select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
