"""Vectors and texts made ready for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.embedding import components, dense, embed
from ..operators import storage, vectors
from .base import Tables, query

_SCORE = "round((1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2, 6)"
_Q = "(SELECT embedding FROM {embeddings} WHERE vec_id = 0) q"


def _query(t: Tables, vec_id: int = 0) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("o84_knn", f"SELECT vec_id, {_SCORE} AS score FROM {{embeddings}} v, {_Q} ORDER BY (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 DESC, vec_id LIMIT 10")
def knn(t: Tables) -> DataFrame:
    return _rounded(vectors.top_k(t.embeddings, "vec_id", "embedding", _query(t), 10))


@query("o64_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o44_hits_with_rows", f"WITH h AS (SELECT vec_id, {_SCORE} AS score FROM {{embeddings}} v, {_Q} ORDER BY (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 DESC, vec_id LIMIT 50) SELECT d.doc_id, d.lang, h.score FROM h JOIN {{documents}} d ON d.doc_id = h.vec_id")
def hits_with_rows(t: Tables) -> DataFrame:
    scores = vectors.top_k(t.embeddings, "vec_id", "embedding", _query(t), 50).withColumnRenamed("vec_id", "doc_id")
    return _rounded(vectors.hits(scores, t.documents.select("doc_id", "lang"), "doc_id"))


@query("o86_knn_filtered", f"SELECT vec_id, {_SCORE} AS score FROM {{embeddings}} v, {_Q} WHERE label IN (2, 3) ORDER BY (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 DESC, vec_id LIMIT 15")
def knn_filtered(t: Tables) -> DataFrame:
    return _rounded(vectors.top_k(t.embeddings, "vec_id", "embedding", _query(t), 15, F.col("label").isin(2, 3)))


@query("o87_knn_mails", f"SELECT vec_id, {_SCORE} AS score FROM {{embeddings}} v JOIN {{mails}} m ON m.conv_id = v.vec_id AND m.turn = 0, {_Q} WHERE m.date_timestamp >= 1600100000 AND regexp_matches(m.subject, 'topic [1-3]', 'i') ORDER BY (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 DESC, vec_id LIMIT 20")
def knn_mails(t: Tables) -> DataFrame:
    wanted = t.mails.where("turn = 0 AND date_timestamp >= 1600100000").where(F.col("subject").rlike("(?i)topic [1-3]")).select(F.col("conv_id").alias("vec_id"))
    return _rounded(vectors.top_k(vectors.by_keys(t.embeddings, wanted, "vec_id"), "vec_id", "embedding", _query(t), 20))


@query("o89_vector_checks", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong, count(*) FILTER (vec_id IN (SELECT doc_id FROM {labels})) AS fetched FROM {embeddings}")
def vector_checks(t: Tables) -> DataFrame:
    """One pass: rows, those of another dimension, those that a set of keys fetches."""
    keys = t.labels.select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("wanted")).distinct()
    is_wrong = F.coalesce(F.size("embedding"), F.lit(-1)) != 64
    return t.embeddings.join(keys, "vec_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_wrong, 1)).alias("wrong"), F.count("wanted").alias("fetched"))


@query("o88_ivf_probe")
def ivf_probe(t: Tables) -> DataFrame:
    """Index of the whole table, one probe; recall is tested against the exact search."""
    model = vectors.fit_index(t.embeddings, "embedding", vectors.cluster_count(t.embeddings.count()), rounds=4)
    indexed = vectors.assign(t.embeddings, "vec_id", "embedding", model)
    return _rounded(vectors.probe(indexed, t.embeddings, "vec_id", "embedding", model, _query(t), 10))


_WORDS = "SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^0-9a-z]+')) AS word FROM {documents}) s WHERE word <> '' AND length(word) <= 100"
#: The components that aren't zero: (doc_id, slot, x) before the vector is brought to unit length.
_SLOTS = f"w AS ({_WORDS}), h AS (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 256 AS slot, CASE WHEN CAST(('0x' || substr(md5(word), 9, 8)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM w), v AS (SELECT doc_id, slot, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY doc_id, slot HAVING sum(s) <> 0)"
_COMPONENTS = f"WITH {_SLOTS} SELECT doc_id, slot, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM v"


def _components(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.inline("entries")).select("doc_id", "slot", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("o82_embed", _COMPONENTS)
def embed_texts(t: Tables) -> DataFrame:
    return _components(components(t.documents, "doc_id", F.col("text")))


@query("o83_backfill", _COMPONENTS + " WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def backfill(t: Tables) -> DataFrame:
    # Merged at any size, so that disk follows the input: the embedding needs texts by key anyway, and takes them from the join.
    have = t.labels.select("doc_id").hint("merge")
    return _components(components(storage.missing_keys(t.documents.select("doc_id", "text"), have, ["doc_id"]), "doc_id", F.col("text")))


@query(
    "o85_knn_by_name",
    f"WITH {_SLOTS}, q AS (SELECT CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 256 AS slot, sum(CASE WHEN CAST(('0x' || substr(md5(word), 9, 8)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS y FROM (SELECT unnest(['void', 'the']) AS word) n GROUP BY 1), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id) SELECT n.doc_id, round((1 + coalesce(sum(v.x * q.y), 0) / max(norm) / (SELECT sqrt(sum(y * y)) FROM q)) / 2, 5) AS score FROM n LEFT JOIN v ON v.doc_id = n.doc_id AND v.slot IN (SELECT slot FROM q) LEFT JOIN q ON q.slot = v.slot GROUP BY n.doc_id ORDER BY score DESC, doc_id LIMIT 10",
)
def knn_by_name(t: Tables) -> DataFrame:
    spark = t.spark
    name = spark.createDataFrame([(0, "void the() {}")], "k int, text string")
    vector = embed(name, "k", F.col("text")).first()["vector"]
    store = dense(components(t.documents, "doc_id", F.col("text")).where(F.size("entries") > 0), "doc_id")
    return vectors.top_k(store, "doc_id", "vector", vector, 10, digits=5)


@query("o81_normalise_code", "SELECT id, name || '(int a) {{ return ' || CAST(id AS VARCHAR) || '; }}' AS code FROM {functions}")
def normalise_code(t: Tables) -> DataFrame:
    messy = F.concat(F.lit("__attribute__((unused)) "), "name", F.lit("(int a) {   /* a\ncomment */ return "), F.col("id").cast("string"), F.lit(";\t}  // end"))
    return t.functions.select("id", text.code_for_embedding(messy).alias("code"))
