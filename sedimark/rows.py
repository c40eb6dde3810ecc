"""Rows through Python functions, with few of them in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of the result, and about as many bytes of their texts, that a task gathers before it hands them on.
ROWS, BYTES = 512, 1 << 20


def _weight(value) -> int:
    if isinstance(value, (str, bytes)):
        return len(value) + 56
    if isinstance(value, (list, tuple)):
        return 64 + sum(map(_weight, value))
    return sum(map(_weight, value.values())) + 64 if isinstance(value, dict) else 32


def map_rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``f`` makes of each row's values; a batch's rows become Python's one by one, not all at once.

    Arrow hands over 10,000 rows of up to 64 MB; objects made of so many take gigabytes, so results leave in small batches.
    """
    types = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(types)
        made, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), target)], schema=target)

        for batch in batches:
            for i in range(batch.num_rows):
                for row in f(*(column[i].as_py() for column in batch.columns)):
                    made.append(row)
                    held += _weight(row)
                    if len(made) >= ROWS or held >= BYTES:
                        yield flush()
                        made, held = [], 0
        if made:
            yield flush()

    return df.mapInArrow(run, schema)
