"""The ``opN_*`` queries: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import documents
from .exact_dedup import exact_dedup
from .langid import language_id
from .packing import best_fit_packing
from .piece_scan import piece_ids
from .pii import digests, personal_data
from .quotes import link_quotations
from .simhash import near_duplicates
from .token_counts import token_counts
from .toxicity import toxicity


def op1_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_ids(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(personal_data(documents(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, in which from the third turn on each message quotes the one two turns before it, linked."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = own.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("said"))
    quote = F.concat(F.lit("> "), F.regexp_replace("said", "\n", "\n> "), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    quoting = own.join(before, ["conv_id", "turn"], "left").withColumn("text", F.coalesce(quote, "text")).select("conv_id", "turn", "role", "text")
    return link_quotations(quoting).select("conv_id", "turn", "reply_conv", "reply_turn", "linked_by", "thread_conv", "depth", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_piece_ids, op2_language_id, op3_best_fit_packing, op4_nearest, op5_chat_formatting, op6_personal_data, op7_exact_dedup, op8_token_counts, op9_simhash, op10_toxicity, chat_quotations)}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NORMAL = r"trim(regexp_replace(lower(%s), '[^\p{L}\p{N}]+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "chat_quotations": f"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, {_NORMAL % "coalesce(text, '')"} AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
        q AS (SELECT c.conv_id, c.turn, min(o.turn) AS said FROM c JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 AND b.n <> '' JOIN c o ON o.conv_id = c.conv_id AND o.n = b.n AND o.turn < c.turn GROUP BY ALL),
        r AS (SELECT c.conv_id, c.turn, c.place, coalesce(said, previous) AS reply_turn, CASE WHEN said IS NOT NULL THEN 'quote' WHEN previous IS NOT NULL THEN 'previous' ELSE 'none' END AS linked_by FROM c LEFT JOIN q ON q.conv_id = c.conv_id AND q.turn = c.turn),
        d(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM r WHERE reply_turn IS NULL UNION ALL SELECT r.conv_id, r.turn, depth + 1 FROM d JOIN r ON r.conv_id = d.conv_id AND r.reply_turn = d.turn)
        SELECT r.conv_id, r.turn, CASE WHEN reply_turn IS NOT NULL THEN r.conv_id END AS reply_conv, reply_turn, linked_by, r.conv_id AS thread_conv, CAST(depth AS BIGINT) AS depth, place FROM r JOIN d ON d.conv_id = r.conv_id AND d.turn = r.turn
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
}
