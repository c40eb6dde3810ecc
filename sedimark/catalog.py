"""The store: Parquet tables in buckets by key, under numbered states that readers and writers agree on.

A state is a small JSON file that lists a table's folders by bucket.  A merge or delete rewrites only the buckets it touches,
an append adds folders; then the next state is created under a number that nobody else can take as well.  A writer that
comes second does its work again on the new state, so no update is lost, and no reader sees half a write.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .operators.storage import delete_where, upsert
from .schemas import BUCKETED_BY, KEYS, SCHEMAS

#: Buckets of a table; more for a larger store.
BUCKETS = 16
#: Times that a writer whose state was taken tries again.
TRIES = 5
_BUCKET = "_bucket"

#: Folders by bucket.
Parts = dict[int, list[str]]


class Catalog:
    """Loads, saves, merges into, appends to and deletes from the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path, fs = self._files()
        return sorted(s.getPath().toString() for s in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []

    def _read(self, file: str) -> str:
        path, fs = self._files()
        stream = fs.open(path(file))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, file: str, text: str) -> bool:
        """False where the file is there already."""
        path, fs = self._files()
        try:
            stream = fs.create(path(file), False)
        except Exception as e:
            if fs.exists(path(file)):
                return False
            raise e
        stream.write(text.encode())
        stream.close()
        return True

    def state(self, table: str) -> tuple[int, Parts]:
        """Number and folders of the newest state; -1 where there is none."""
        found = [f for f in self._list(f"{self.root}/{table}/states") if f.endswith(".json")]
        if not found:
            return -1, {}
        return int(found[-1].rsplit("/", 1)[1][:-5]), {int(k): v for k, v in json.loads(self._read(found[-1])).items()}

    def _load(self, table: str, parts: Parts, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, own in sorted(parts.items()) if only is None or b in only for f in own]
        schema = SCHEMAS[table]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def load(self, table: str, **equal: list) -> DataFrame:
        """The table; an empty one where there is none.  ``equal``: values of the columns it is bucketed by, whose buckets alone are read."""
        _, parts = self.state(table)
        if not equal:
            return self._load(table, parts)
        (column, values), = equal.items()
        if BUCKETED_BY.get(table, KEYS.get(table, [])) == [column]:
            wanted = self.spark.createDataFrame([(v,) for v in values], f"{column} string").select(self._bucket_of(table))
            return self._load(table, parts, [r[0] for r in wanted.distinct().collect()]).where(F.col(column).isin(values))
        return self._load(table, parts).where(F.col(column).isin(values))

    def _bucket_of(self, table: str) -> Column:
        keys = BUCKETED_BY.get(table, KEYS.get(table, []))
        return (F.pmod(F.xxhash64(*keys), F.lit(self.buckets)) if keys else F.lit(0)).cast("int").alias(_BUCKET)

    def _write(self, table: str, df: DataFrame) -> Parts:
        """The rows of ``df`` in new folders, one for each bucket that has any."""
        folder = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        own = df.withColumn(_BUCKET, self._bucket_of(table))
        own.repartition(_BUCKET).sortWithinPartitions(_BUCKET, *KEYS.get(table, [])).write.partitionBy(_BUCKET).parquet(folder)
        return {int(f.rsplit("=", 1)[1]): [f] for f in self._list(folder) if f"{_BUCKET}=" in f}

    def _change(self, table: str, change: Callable[[Parts], Parts]) -> None:
        """Makes ``change`` of the newest state the next one."""
        for _ in range(TRIES):
            number, parts = self.state(table)
            after = {k: v for k, v in change(parts).items() if v}
            if self._create(f"{self.root}/{table}/states/{number + 1:012d}.json", json.dumps(after)):
                self._forget(table, number)
                return
        raise RuntimeError(f"{table}: others were faster {TRIES} times")

    def _forget(self, table: str, before: int) -> None:
        """The state before stays for readers that have begun; what only older ones list goes."""
        path, fs = self._files()
        states = self._list(f"{self.root}/{table}/states")
        old = [f for f in states if int(f.rsplit("/", 1)[1][:-5]) < before]
        listed = lambda files: {p for f in files for own in json.loads(self._read(f)).values() for p in own}
        for folder in listed(old) - listed([f for f in states if f not in old]):
            fs.delete(path(folder), True)
        for f in old:
            fs.delete(path(f), False)

    def save(self, table: str, df: DataFrame) -> None:
        """The whole table anew."""
        made = self._write(table, self._shaped(table, df))
        self._change(table, lambda _: made)

    def merge(self, table: str, new: DataFrame) -> None:
        """Rows of ``new`` take the place of those with their key, or are added."""
        fresh = cut(self._shaped(table, new))
        touched = [r[0] for r in fresh.select(self._bucket_of(table)).distinct().collect()]
        if touched:
            self._change(table, lambda parts: parts | self._write(table, upsert(self._load(table, parts, touched), fresh, KEYS[table])))

    def append(self, table: str, new: DataFrame) -> None:
        made = self._write(table, self._shaped(table, new))
        self._change(table, lambda parts: {b: parts.get(b, []) + made.get(b, []) for b in {*parts, *made}})

    def _shaped(self, table: str, df: DataFrame) -> DataFrame:
        """The table's columns and types; others are left out."""
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))

    def delete(self, table: str, predicate: Column) -> None:
        def change(parts: Parts) -> Parts:
            hit = [r[0] for r in self._load(table, parts).where(predicate).select(self._bucket_of(table)).distinct().collect()]
            kept = {b: own for b, own in parts.items() if b not in hit}
            return kept | self._write(table, delete_where(self._load(table, parts, hit), predicate)) if hit else kept

        self._change(table, change)

    def fragments(self, table: str) -> tuple[int, int, int]:
        """Files of the table, those below 16 MB, and bytes in all."""
        path, fs = self._files()
        sizes = [s.getLen() for own in self.state(table)[1].values() for f in own for s in fs.listStatus(path(f)) if s.getPath().getName().endswith(".parquet")]
        return len(sizes), sum(n < 16 << 20 for n in sizes), sum(sizes)

    def due(self, table: str, most: int = 600, small: float = 0.5, mean: int = 1 << 20) -> bool:
        """Whether to compact: too many files, or more than one a bucket and most of them, or all on the average, small."""
        files, few, size = self.fragments(table)
        return files > most or files > max(1, len(self.state(table)[1])) and (few > small * files or size < mean * files)

    def compact(self, table: str, file_bytes: int = 256 << 20) -> None:
        """Every bucket in files of about ``file_bytes``, sorted by key, so that statistics of row groups prune lookups."""
        def change(parts: Parts) -> Parts:
            size, out = self.fragments(table)[2], {}
            per = max(1, -(-size // max(1, len(parts)) // file_bytes))
            keys = KEYS.get(table, [])
            for bucket, own in parts.items():
                df = self._load(table, {bucket: own})
                folder = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
                (df.repartitionByRange(per, *keys).sortWithinPartitions(*keys) if keys else df.repartition(per)).write.parquet(folder)
                out[bucket] = [folder]
            return out

        if self.state(table)[1]:
            self._change(table, change)

    def maintain(self) -> list[str]:
        """Compacts the tables that are due; which."""
        found = [t for t in SCHEMAS if self.state(t)[1] and self.due(t)]
        for table in found:
            self.compact(table)
        return found

    def drop(self, table: str) -> None:
        path, fs = self._files()
        fs.delete(path(f"{self.root}/{table}"), True)

    @contextmanager
    def task(self, name: str) -> Iterator[None]:
        """Notes that the task is InProgress, then Completed or Failed."""
        self._note(name, "InProgress")
        try:
            yield
        except BaseException as e:
            self._note(name, "Failed", str(e)[:500])
            raise
        self._note(name, "Completed")

    def _note(self, name: str, state: str, detail: str = "") -> None:
        self._create(f"{self.root}/_tasks/{name}/{time.time_ns():020d}.json", json.dumps({"state": state, "detail": detail}))

    def task_states(self, *names: str) -> DataFrame:
        """(task, state, detail, at: seconds): the newest note of each task; NotStarted where there is none."""
        rows = []
        for name in names or [f.rsplit("/", 1)[1] for f in self._list(f"{self.root}/_tasks")]:
            notes = self._list(f"{self.root}/_tasks/{name}")
            note = json.loads(self._read(notes[-1])) if notes else {"state": "NotStarted", "detail": ""}
            rows.append((name, note["state"], note["detail"], int(notes[-1].rsplit("/", 1)[1][:-5]) // 10**9 if notes else None))
        return self.spark.createDataFrame(rows, "task string, state string, detail string, at bigint")
