"""Vectors: exact nearest neighbours with filters before the cut; clusters and product codes as a stored index.

The index is of inverted lists with product quantisation: a vector's cluster, and its residual from the cluster's centre cut
into parts, each of which is coded as the nearest of 256 part-centres.  A probe scores codes by one table of inner products
a part, and compares the best of them exactly.  Vectors are taken at unit length, so that products are cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a product code, and part-centres of each: one byte a part.
PARTS, CODES = 8, 256

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity(a: Column, b: Column) -> Column:
    """(1 + cosine) / 2, everywhere."""
    return (1 + cosine(a, b)) / 2


def query_column(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """(key, score): exact; filters come before the cut, so none of the best is lost; each task keeps k rows.

    With ``digits`` scores are rounded first, so that what differs in the order of addition alone is a tie and goes by key.
    """
    own = vectors if where is None else vectors.where(where)
    score = similarity(F.col(vector), query_column(query))
    scored = own.where(F.size(vector) == len(query)).select(key, (score if digits is None else F.round(score, digits)).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def hits(scores: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows with the score of their key."""
    return rows.join(scores, key)


def by_keys(vectors: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return vectors.join(keys.select(key).distinct(), key, "left_semi")


def wrong_dimension(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    return vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != dimension)


def cluster_count(rows: int) -> int:
    """Clusters of an index: the root of the rows between 256 and 1024, at least two for few rows, none below ten."""
    if rows < 10:
        return 0
    root = int(rows**0.5)
    return max(2, root) if rows < 256 else min(1024, max(256, root))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = x[: min(k, len(x))].copy()
    for _ in range(rounds if len(x) else 0):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


@dataclass
class IndexModel:
    """Centres of clusters (k, d) and of parts (PARTS, CODES, d / PARTS)."""

    centres: np.ndarray
    parts: np.ndarray

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        padded = np.pad(x, ((0, 0), (0, self.parts.shape[0] * self.parts.shape[2] - x.shape[1])))
        return np.split(padded, self.parts.shape[0], axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = _unit(x)
        near = _nearest(x, self.centres)
        return near, np.stack([_nearest(part, c) for part, c in zip(self.split(x - self.centres[near]), self.parts)], axis=1).astype(np.uint8)

    def rows(self) -> list[tuple]:
        """As rows of the table vector_model."""
        dim = self.centres.shape[1]
        return [("centres", dim, 0, bytearray(self.centres.astype("<f8").tobytes()))] + [("part", dim, i, bytearray(c.astype("<f8").tobytes())) for i, c in enumerate(self.parts)]

    @classmethod
    def of(cls, rows: list) -> IndexModel:
        read = lambda r: np.frombuffer(bytes(r["data"]), "<f8")
        parts = [read(r) for r in sorted((r for r in rows if r["name"] == "part"), key=lambda r: r["part"])]
        centres = next(r for r in rows if r["name"] == "centres")
        width = -(-centres["dimension"] // len(parts))
        return cls(read(centres).reshape(-1, centres["dimension"]), np.stack([p.reshape(-1, width) for p in parts]))


def fit_index(vectors: DataFrame, vector: str, clusters: int, sample: int = 16_384, rounds: int = 10, parts: int = PARTS) -> IndexModel:
    """Centres by k-means on a bounded, deterministic sample, the one thing that reaches the driver."""
    own = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0").orderBy(F.xxhash64("v")).limit(sample)
    x = _unit(np.array([r["v"] for r in own.collect()]))
    centres = _kmeans(x, clusters, rounds)
    model = IndexModel(centres, np.zeros((parts, 1, -(-x.shape[1] // parts))))
    residuals = model.split(x - centres[_nearest(x, centres)])
    found = [_kmeans(r, CODES, rounds) for r in residuals]
    return IndexModel(centres, np.stack(found))


def assign(vectors: DataFrame, key: str, vector: str, model: IndexModel) -> DataFrame:
    """(key, cluster, code) of the vectors of the model's dimension; the model travels with the tasks."""
    dim = model.centres.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, codes = model.encode(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "cluster", "code"])

    own = vectors.where(F.size(vector) == dim).select(key, F.col(vector).cast("array<double>").alias("v"))
    return own.mapInArrow(encode, f"{key} {vectors.schema[key].dataType.simpleString()}, cluster int, code binary")


def probe(index: DataFrame, vectors: DataFrame, key: str, vector: str, model: IndexModel, query: list[float], k: int, probes: int = 10, refine: int = 20) -> DataFrame:
    """(key, score): of the ``probes`` clusters nearest to the query, the best ``refine`` * ``k`` by their codes, compared exactly.

    Each task keeps ``refine`` * ``k`` rows; originals are read for those alone.
    """
    q = _unit(np.array([query], np.float64))
    order = np.argsort(-(q @ model.centres.T - 0.5 * (model.centres**2).sum(axis=1))[0], kind="stable")[:probes].tolist()
    table = np.stack([part @ c.T for part, c in zip(model.split(q), model.parts)])[:, 0]
    base = (q @ model.centres.T)[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, len(table))
            value = base[batch.column(1).to_numpy()] + table[np.arange(len(table)), codes].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], [key, "about"])

    near = index.where(F.col("cluster").isin(order)).select(key, "cluster", "code")
    best = near.mapInArrow(score, f"{key} {index.schema[key].dataType.simpleString()}, about double").orderBy(F.desc("about"), key).limit(refine * k)
    return top_k(vectors.join(best.select(key), key, "left_semi"), key, vector, query, k)
