"""Exact duplicates by distributed most-significant-digit radix partitioning.

A text is the digit string *length, byte 0, byte 1, ...* of its UTF-8 form with
A-Z lower-cased.  Partitioning goes down that string, most significant digit
first, until a group is a singleton or its texts have ended; texts that reach the
end of the string together are equal, so no digest decides anything.

* **Within a block of input** groups are split by successive byte slices, the
  slices growing as a group survives.  Copies within a block collapse into one
  representative before anything is shuffled: a text that makes up a third of
  all rows leaves a block as one row.
* **Between blocks** the representatives are shuffled by their leading digits
  (length and first bytes).  A group that a task can hold is split to the end there.
  A larger one, many texts of one head or one text of every block, is split on the
  cluster by its next bytes, a slice eight times as long each round; a group whose
  texts have ended is one class, put together by an aggregate with a map side.
* Members find their class through their block's representative, a key that
  at most one block of rows shares.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, own_folder

#: Bytes of the text that count as leading digits in a shuffle key.
LEADING = 48
#: Bytes of representatives with equal leading digits that one task holds.
GROUP_BYTES = 64 << 20

_LOCAL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("local", pa.int64()), ("rep", pa.bool_()), ("n", pa.int64()), ("top", pa.int64()), ("size", pa.int64()), ("lead", pa.binary()), ("norm", pa.binary())])
_LOCAL_DDL = "row long, doc_id long, text_sha256 string, local long, rep boolean, n long, top long, size long, lead binary, norm binary"


def radix_classes(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts, grouped by splitting on length and then on successive byte slices."""
    done: list[list[int]] = []
    first: dict[int, list[int]] = defaultdict(list)
    for i, text in enumerate(texts):
        first[len(text)].append(i)
    pending = [(group, 0, 8) for group in first.values()]
    while pending:
        group, depth, width = pending.pop()
        if len(group) == 1 or depth >= len(texts[group[0]]):
            done.append(group)
            continue
        split: dict[bytes, list[int]] = defaultdict(list)
        for i in group:
            split[texts[i][depth : depth + width]].append(i)
        pending.extend((part, depth + width, min(width * 8, 1 << 20)) for part in split.values())
    return done


def _local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, counter = TaskContext.get().partitionId() << 36, 0
    for batch in blocks(batches, "text", 32 << 20):
        rows = batch.column(0).to_pylist()
        ids = batch.column(1).to_pylist()
        texts = [(t or b"").lower() for t in batch.column(2).to_pylist()]  # bytes.lower touches A-Z only
        out: list[list] = [[None] * len(texts) for _ in range(6)]
        for group in radix_classes(texts):
            # The largest doc_id stands for the class, nulls below all, the first of equal rows.
            best = max(group, key=lambda i: (ids[i] is not None, ids[i] or 0, -i))
            sha = hashlib.sha256(texts[best]).hexdigest()
            for i in group:
                out[0][i], out[1][i], out[2][i] = sha, base + counter, i == best
            out[3][best], out[4][best], out[5][best] = len(group), ids[best], len(texts[best])
            counter += 1
        reps = out[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(reps, pa.bool_()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64()),
                pa.array([t[:LEADING] if r else None for t, r in zip(texts, reps)], pa.binary()),
                pa.array([t if r else None for t, r in zip(texts, reps)], pa.binary()),
            ],
            schema=_LOCAL,
        )


_MERGED_DDL = "local long, root long, group_size long, keep_id long"
_MERGED = pa.schema([("local", pa.int64()), ("root", pa.int64()), ("group_size", pa.int64()), ("keep_id", pa.int64())])


class _Merger:
    """Classes of the representatives (key columns, local, n, top, norm) that stream by, sorted by their keys, of which each is held as a whole."""

    def __init__(self, keys: int):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for at, own in zip(zip(*columns[: self.keys]), zip(*columns[self.keys :])):
                if at != key:
                    out.extend(self.classes(held))
                    key, held = at, []
                    if len(out) >= 2000:
                        yield self.batch(out)
                        out = []
                held.append(own)
        out.extend(self.classes(held))
        if out:
            yield self.batch(out)

    @staticmethod
    def classes(held: list[tuple]) -> Iterator[tuple]:
        """Of (local, n, top, norm): one group of equal leading digits."""
        for group in [[0]] if len(held) == 1 else radix_classes([h[3] for h in held]):
            local, _, top, _ = max((held[i] for i in group), key=lambda h: (h[2] is not None, h[2] or 0, -h[0]))
            total = sum(held[i][1] for i in group)
            for i in group:
                yield held[i][0], local, total, top

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MERGED)], schema=_MERGED)


def _merged(reps: DataFrame, *keys: str) -> DataFrame:
    """(local, root, group_size, keep_id) of representatives whose groups by ``keys`` a task can hold."""
    return reps.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "local", "n", "top", "norm").mapInArrow(_Merger(len(keys)), _MERGED_DDL)


def _split(reps: DataFrame, limit: int) -> DataFrame:
    """As ``_merged``, of representatives (local, n, top, size, lead, norm) whose groups by (size, lead) may be of any size."""
    numbered = lambda df: cut(df.withColumn("next", F.monotonically_increasing_id()))
    groups = reps.groupBy("size", "lead").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k"))
    large = numbered(groups.where((F.col("bytes") > limit) & (F.col("k") > 1)).select("size", "lead"))
    if large.isEmpty():
        return _merged(reps, "size", "lead")
    out = [_merged(reps.join(large, ["size", "lead"], "left_anti"), "size", "lead")]
    deep, depth, width = cut(reps.join(large, ["size", "lead"]).select(F.col("next").alias("at"), "local", "n", "top", "size", "norm")), LEADING, 8 * LEADING
    while True:
        deep = deep.withColumn("slice", F.substring("norm", depth + 1, width))
        groups = numbered(deep.groupBy("at", "slice").agg(F.max("size").alias("long"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("group_size"), F.max(F.struct(F.col("top").isNotNull(), F.coalesce("top", F.lit(0)), -F.col("local"), "top")).alias("best")))
        ended, held = F.col("long") <= depth + width, (F.col("bytes") <= limit) | (F.col("k") == 1)
        known = deep.join(groups.select("at", "slice", "next", "long", "bytes", "k"), ["at", "slice"])
        whole = groups.where(ended).select("at", "slice", (-F.col("best.col3")).alias("root"), "group_size", F.col("best.top").alias("keep_id"))
        out.append(deep.join(whole, ["at", "slice"]).select("local", "root", "group_size", "keep_id"))
        out.append(_merged(known.where(~ended & held), "next"))
        deep = cut(known.where(~ended & ~held).select(F.col("next").alias("at"), "local", "n", "top", "size", "norm"))
        if deep.isEmpty():
            return reduce(DataFrame.unionByName, out)
        depth, width = depth + width, min(8 * width, 1 << 24)


def exact_dedup(docs: DataFrame, row: Column | None = None, limit: int = GROUP_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and ``row`` where it is given).

    Texts are equal when identical after lower-casing A-Z; null is the empty text.  The largest doc_id of a class
    stays, exactly one row of it even where rows repeat (then one of the equal ones); null ids are below all others.
    An empty table gives an empty one.  Only doc_id and text are read; other columns may have any names.
    ``limit``: bytes of representatives with equal leading digits that one task holds.
    """
    spark = docs.sparkSession
    narrow = docs.select((row if row is not None else F.lit(None)).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Written once: members and representatives must agree on the numbers of the classes even when a task is run again.
    path = own_folder(spark, "radix")
    narrow.mapInArrow(_local_classes, _LOCAL_DDL).write.parquet(path)
    local = spark.read.parquet(path)
    members = local.select("row", "doc_id", "text_sha256", "local", "rep")
    final = _split(local.filter("rep").select("local", "n", "top", "size", "lead", "norm"), limit)
    kept = F.col("rep") & (F.col("local") == F.col("root"))
    return members.join(final, "local").select(*(["row"] if row is not None else []), "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
