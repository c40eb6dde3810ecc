"""A deterministic embedder for text without a model file: signed hashed features of words, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

DIMENSION = 256


def components(df: DataFrame, key: str, text: Column, dimension: int = DIMENSION) -> DataFrame:
    """(key, entries): slots and values of the unit vector that aren't zero, by slot; none for text without a word, and for one whose words take each other away.

    A word's slot and sign are digits of its MD5, a code of a few bits.  Rows of a key are put together by their sorted codes,
    the one shuffle; words are summed by slot after it, where they are.
    """
    slot = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(dimension)).cast("int")
    is_odd = lambda h: F.substring(h, 16, 1).isin(*"13579bdf").cast("int")
    # The array of one is for a name of the digits, so that they are worked out once, and of one word at a time.
    code = lambda word: F.coalesce(F.get(F.transform(F.array(F.md5(word.cast("binary"))), lambda h: slot(h) * 2 + is_odd(h)), F.lit(0)), F.lit(0))
    coded = df.select(key, F.sort_array(F.transform(tokens(text), code)).alias("codes")).repartition(key)
    words = coded.select(key, F.explode_outer("codes").alias("code"))
    sums = words.groupBy(key, F.shiftright("code", 1).alias("slot")).agg(F.sum(1 - 2 * (F.col("code") % 2)).cast("double").alias("x"))
    whole = F.col("x") != 0
    rows = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.when(whole, F.struct("slot", "x")))).alias("sums"), F.sqrt(F.sum(F.when(whole, F.col("x") * F.col("x")))).alias("norm"))
    return rows.select(key, F.transform("sums", lambda e: F.struct(e["slot"].alias("slot"), (e["x"] / F.col("norm")).cast("float").alias("value"))).alias("entries"))


def dense(df: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, vector) of components: zeros up to each entry, the entry, and zeros after the last."""
    entries, zeros = F.col("entries"), lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    before = lambda i: F.coalesce(F.get(entries, i - 1)["slot"], F.lit(-1))
    parts = F.transform(entries, lambda e, i: F.concat(zeros(e["slot"] - before(i) - 1), F.array(e["value"])))
    return df.select(key, F.concat(F.flatten(parts), zeros(dimension - 1 - before(F.size(entries)))).alias("vector"))


def embed(df: DataFrame, key: str, text: Column, dimension: int = DIMENSION) -> DataFrame:
    """(key, vector): unit length; the zero vector for text without a word, and for one whose words take each other away."""
    return dense(components(df, key, text, dimension), key, dimension)
