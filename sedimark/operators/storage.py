"""Content-addressed storage, merges and table-level reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Bytes of a body that are stored.
MAX_BODY = 10 << 20


def shard_of(hash_: Column) -> Column:
    """0 to 15: the first hexadecimal digit; 0 for what begins with none."""
    first = F.lower(F.substring(hash_, 1, 1))
    return F.when(first.rlike("^[0-9a-f]$"), F.conv(first, 16, 10).cast("int")).otherwise(0)


def content_store(texts: DataFrame, column: str, most: int | None = MAX_BODY) -> DataFrame:
    """(hash, content, shard): each distinct non-empty text once.  The hash decides, so only hashes are shuffled twice.

    Of texts beyond ``most`` bytes the beginning is stored and hashed, as whole characters; None stores all of every text.
    """
    text = F.col(column)
    if most is not None:
        # An incomplete last character has up to three bytes.
        head = lambda n: F.try_validate_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
        text = F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*(head(most - i) for i in range(4))))
    own = texts.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.sha1(text.cast("binary")).alias("hash"), text.alias("content"))
    return own.groupBy("hash").agg(F.first("content").alias("content")).select("hash", "content", shard_of(F.col("hash")).alias("shard"))


def resolve_content(rows: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """``rows`` with the text behind ``key`` as body; the empty text where there is none."""
    return rows.join(content.select(F.col("hash").alias("_hash"), F.col("content").alias("body")), F.col(key) == F.col("_hash"), "left").drop("_hash").withColumn("body", F.coalesce("body", F.lit("")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` in the place of those of ``old`` with the same key, or added; one row a key.

    Of several new rows with one key the last by ``order`` wins, and of those that are equal in it the greatest as JSON, so
    that a run that is repeated gives the same.
    """
    same = reduce(lambda a, b: a & b, (F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys))
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order or []), F.desc("_all"))
    fresh = new.withColumn("_all", F.to_json(F.struct(*new.columns))).withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_all", "_place")
    return old.alias("o").join(fresh.alias("n"), same, "left_anti").unionByName(fresh)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows for which the predicate is true; unknown isn't true."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def missing_keys(candidates: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't stored yet."""
    return candidates.join(stored.select(*keys), keys, "left_anti")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Rows that are equal in every column, with how often they occur, if more than once."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_report(df: DataFrame) -> DataFrame:
    """total_rows, duplicate_groups, rows_in_groups in one pass over the grouped rows."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    many = F.when(F.col("copies") > 1, F.col("copies"))
    return counts.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"), F.count(many).alias("duplicate_groups"), F.coalesce(F.sum(many), F.lit(0)).alias("rows_in_groups"))


def symbol_table(functions: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct (symbol, filename) of functions and types."""
    pair = lambda df: df.select(F.col("name").alias("symbol"), F.col("file_path").alias("filename"))
    return pair(functions).unionByName(pair(types)).distinct()


def content_usage(tables: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """(hash, uses): hashes that the tables (each with a column hash) use ``least`` times or more together."""
    every = reduce(DataFrame.unionByName, (df.select("hash") for df in tables.values()))
    return every.where("hash IS NOT NULL").groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): a count of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))


def shard_statistics(content: DataFrame) -> DataFrame:
    """Entries and exact mean and total bytes of each shard."""
    size = F.octet_length("content")
    return content.groupBy("shard").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"), F.avg(size).alias("mean_bytes"))


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its place (from 1) in a total order: a row's place in its sorted partition after all rows of those before."""
    parts = cut(df.orderBy(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return parts.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_within") + 1).alias("place"))


#: Rows that a page may have the driver hold.
NEAR = 10_000


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; a total order is the caller's.

    The driver holds all rows up to a page's end only while they are few; pages further on are cut out by ``placed``.
    """
    if number < 1:
        raise ValueError("pages count from 1")
    if number * size <= NEAR:
        return df.orderBy(*order).offset((number - 1) * size).limit(size)
    return placed(df, order).where(F.col("place").between((number - 1) * size + 1, number * size)).drop("place")


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The ``size`` rows that follow ``last`` by a unique key (None: the first ones); the filter prunes the scan."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)


def paged_lines(text: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, page, line, content): a text's lines, ``size`` a page, both from 1."""
    lines = text.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    return lines.select("doc_id", (F.floor(F.col("pos") / size) + 1).cast("int").alias("page"), (F.col("pos") + 1).alias("line"), "content")


def with_limit_flag(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and a one-row table that tells whether there were more."""
    some = df.orderBy(*order).limit(limit + 1)
    return some.orderBy(*order).limit(limit), some.agg((F.count(F.lit(1)) > limit).alias("limit_hit"))


def running_rank(keys: list[str], order: list[Column]):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
