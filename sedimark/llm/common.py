"""Helpers that the operators share: checkpoints, Arrow blocks, tokenizer paths."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker holds at once, apart from one text longer than this.
BLOCK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, on one machine alone, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sedimark-"))
    return named or context.getCheckpointDir()


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it goes when the driver ends, since results may be read until then."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``df`` written in the shared folder in as many buckets by ``key`` as a shuffle has partitions: joins on it don't shuffle it again."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{kind}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", own_folder(spark, kind)).saveAsTable(name)
    return spark.table(name)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` each.

    A text longer than the limit is a slice by itself.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        if values.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def balanced(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """As ``blocks``, and batches of few bytes are put together until they hold about ``limit``."""
    held, size = [], 0
    for batch in blocks(batches, column, limit):
        n = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; such files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
