"""Incremental ingest, in batches and as streams whose offset log is the skip set.

Every batch merges by key, so a batch that is run again changes nothing.  Mails may
come however late: what is stored is looked up in the store and not in a state that a
watermark would have to bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..checkpoints import cut
from ..extract.code import extract_sources, functions_of, types_of
from ..operators.mail import token_index
from ..operators.storage import missing_keys, shard_of, symbol_table
from ..schemas import SCHEMAS
from ..sources.mail import parse_mails


def rows_of(blobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Functions, types and content (hash, content, shard) of files (file_path, git_file_hash, content), as the store has them."""
    extracted = cut(extract_sources(blobs))
    functions, types = functions_of(extracted), types_of(extracted)
    full = F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["type_name"].alias("type_name"), F.lit(None).cast("string").alias("type_file_path"), F.lit(None).cast("string").alias("type_git_file_hash")))
    fields = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["type_name"].alias("type_name"), F.lit(None).cast("bigint").alias("offset")))
    bodies = functions.select("body").union(types.select("definition"))
    texts = bodies.where("body <> ''").select(F.sha2(F.col("body").cast("binary"), 256).alias("hash"), F.col("body").alias("content")).dropDuplicates(["hash"])
    shaped = lambda df, table: df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.sparkSession.createDataFrame([], SCHEMAS[table]).schema))
    return shaped(functions.drop("body").withColumn("parameters", full), "functions"), shaped(types.drop("definition").withColumn("fields", fields), "types"), texts.withColumn("shard", shard_of(F.col("hash")))


def ingest_sources(catalog: Catalog, blobs: DataFrame, git_sha: str | None = None) -> int:
    """Files (file_path, git_file_hash, content) that aren't processed yet; how many.

    Keyed by path and blob: the same text at two paths is indexed under both.  Files are marked last.
    """
    done = catalog.load("processed_files").select(F.col("file").alias("file_path"), F.col("git_file_sha").alias("git_file_hash"))
    fresh = cut(missing_keys(blobs.dropDuplicates(["file_path", "git_file_hash"]), done, ["file_path", "git_file_hash"]).select("file_path", "git_file_hash", "content"))
    functions, types, content = rows_of(fresh)
    catalog.merge("content", content)
    catalog.merge("functions", functions)
    catalog.merge("types", types)
    catalog.merge("symbol_filename", symbol_table(functions, types))
    seen = fresh.select(F.col("file_path").alias("file"), F.lit(git_sha).cast("string").alias("git_sha"), F.col("git_file_hash").alias("git_file_sha"))
    catalog.append("processed_files", seen)
    return fresh.count()


def ingest_commits(catalog: Catalog, commits: DataFrame) -> int:
    """Commits (as the git source gives them) that aren't stored yet, with tags and symbols; how many."""
    from ..extract.diffs import symbols_of_diff
    from ..operators.commits import tag_map

    fresh = cut(missing_keys(commits, catalog.load("git_commits"), ["git_sha"]))
    symbols = F.pandas_udf(lambda s: s.map(lambda d: symbols_of_diff(d or "")), "array<string>")
    rows = fresh.join(tag_map(fresh), "git_sha").withColumn("symbols", symbols("diff"))
    catalog.merge("git_commits", rows)
    return fresh.count()


def ingest_mails(catalog: Catalog, raw: DataFrame) -> int:
    """Mails (git_commit_sha, raw) of archive commits not indexed yet; only commits whose mail was stored are marked."""
    fresh = missing_keys(raw, catalog.load("lore_indexed_commits"), ["git_commit_sha"])
    mails = cut(parse_mails(fresh))
    known = missing_keys(mails.dropDuplicates(["message_id"]), catalog.load("lore"), ["message_id"])
    stored = cut(known)
    catalog.append("lore", stored)
    catalog.append("lore_tokens", token_index(stored.select("message_id", F.concat_ws(" ", "subject", "body").alias("words")), "message_id", "words"))
    catalog.merge("lore_indexed_commits", mails.select("git_commit_sha"))
    return stored.count()


def stream_mails(spark: SparkSession, catalog: Catalog, folder: str, checkpoint: str):
    """A stream over JSON files of (git_commit_sha, raw) as they arrive; start it, or run it once over what is there."""
    source = spark.readStream.schema("git_commit_sha string, raw string").json(folder)
    return source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest_mails(catalog, batch) and None)


def branches_to_index(tips: DataFrame, indexed: DataFrame) -> DataFrame:
    """(branch_name, tip_commit, since): branches whose tip isn't indexed; ``since`` is null where a whole tree is due."""
    known = indexed.select("branch_name", F.col("tip_commit").alias("since"))
    return tips.join(known, "branch_name", "left").where("since IS NULL OR since <> tip_commit").select("branch_name", "tip_commit", "since")


def windowed_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """An extension beyond the store: events by type in tumbling windows, late ones up to a watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
