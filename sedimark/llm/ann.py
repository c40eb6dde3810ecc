"""Nearest neighbours by inner product, from randomly rotated one-bit codes.

Index: centroids from a bounded sample; every vector's residual from its nearest
centroid is rotated at random in a space of at least 256 dimensions and kept as one
bit a dimension, with the residual's norm and the inner product of the unit residual
with its own code.  From the packed code and these two numbers the inner product with
a query is estimated without bias, and an error bound that holds with high probability
tells between which limits it lies.

Search: a query goes to the clusters whose centroids promise most, as many as a
sample of queries needs by brute force to have its neighbours in them.  Clusters are
cut into blocks of rows and of queries, so that no task holds more than one block
of each.  In a block, only vectors whose upper limit reaches the query's k-th
lower limit are reranked exactly, in double precision, on the original vectors.  Those
travel with their codes: a query keeps hundreds of vectors to rerank, so fetching
them afterwards, one by one, would move more bytes than a block's vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors that centroids are fitted on: so many for each centroid, so many at least, and so many bytes at most.
SAMPLE_PER_CLUSTER, SAMPLE_ROWS, SAMPLE_BYTES = 16, 16_384, 32 << 20
#: Clusters that a query is sent to at least, and rows that these hold together at least.
PROBES = 24
LEAST_ROWS = 2_000
#: Queries that are answered by brute force, and the share of their neighbours that the clusters probed must hold.
TRIAL_QUERIES = 128
TRIAL_RECALL = 0.97
BLOCK = 8_192
#: Width of the error bound, in standard deviations.
WIDTH = 2.5
#: Bits of a code at least.
BITS = 256
SEED = 20_11


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """(row, vec_id, v) of the vectors that take part, their most frequent dimension, and the type of v."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    kind = kind if kind == "array<float>" else "array<double>"
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND exists(v, x -> x != 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own, sizes["d"] if sizes else 0, kind


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def projection(dim: int, seed: int = SEED) -> np.ndarray:
    """dim x bits: a random rotation of the space that has ``BITS`` dimensions at least, on its first ``dim``."""
    return rotation(max(BITS, -(-dim // 64) * 64), seed)[:dim]


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class _Encode:
    """row, vec_id, v -> also cluster, packed code, norm of the residual, inner product of the unit residual and its code."""

    def __init__(self, c: np.ndarray, p: np.ndarray):
        self.c, self.p = c, p

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, bits = self.p.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), dim)
            near = _nearest(x, self.c)
            rotated = (x - self.c[near]) @ self.p
            norm = np.linalg.norm(rotated, axis=1)
            own = np.abs(rotated).sum(axis=1) / np.sqrt(bits) / np.where(norm > 0, norm, 1)
            codes = np.packbits(rotated > 0, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32)), pa.array(own.astype(np.float32))], ["row", "vec_id", "v", "cluster", "code", "norm", "own"])


class _Route:
    """A query's clusters: the best by inner product with the centroid, until they are enough and hold enough rows."""

    def __init__(self, c: np.ndarray, sizes: np.ndarray, probes: int, least: int):
        self.c, self.sizes, self.probes, self.least = c, sizes, probes, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(2), self.c.shape[1])
            order = np.argsort(-(q @ self.c.T), axis=1, kind="stable")
            held = np.cumsum(self.sizes[order], axis=1)
            n = np.minimum(np.maximum(self.probes, (held < self.least).sum(axis=1) + 1), self.c.shape[0])
            row = np.repeat(np.arange(len(q)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(3)), pa.array(order[row, place].astype(np.int32))], ["asker", "query_id", "q", "cluster"])


class _Trial:
    """Of a batch of vectors, the ``k`` best of each trial query: asker, row, score and the place of the vector's cluster among the query's."""

    def __init__(self, c: np.ndarray, askers: np.ndarray, q: np.ndarray, k: int):
        self.c, self.askers, self.q, self.k = c, askers, q, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.argsort(np.argsort(-(self.q @ self.c.T), axis=1, kind="stable"), axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, near = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            score = self.q @ _matrix(batch.column(1), self.c.shape[1]).T
            score[self.askers[:, None] == row[None, :]] = -np.inf
            best = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            i = np.repeat(np.arange(len(self.askers)), best.shape[1])
            at = best.ravel()
            i, at = i[ok := score[i, at] > -np.inf], at[ok]
            yield pa.RecordBatch.from_arrays([pa.array(self.askers[i]), pa.array(row[at]), pa.array(score[i, at]), pa.array(place[i, near[at]].astype(np.int32))], ["asker", "row", "score", "place"])


def probes_needed(index: DataFrame, queries: DataFrame, c: np.ndarray, k: int) -> int:
    """Clusters that hold ``TRIAL_RECALL`` of the true neighbours of a sample of queries; one scan of the index."""
    trial = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "row").limit(TRIAL_QUERIES).select("row", "v").collect()
    if not trial:
        return 0
    askers, q = np.array([r["row"] for r in trial], np.int64), np.array([r["v"] for r in trial], np.float64)
    best = index.select("row", "v", "cluster").mapInArrow(_Trial(c, askers, q, k), "asker long, row long, score double, place int")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "row")
    true = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = {r["place"]: r["count"] for r in true.groupBy("place").count().collect()}
    total, seen = sum(held.values()), 0
    for place in sorted(held):
        seen += held[place]
        if seen >= TRIAL_RECALL * total:
            return place + 1
    return 0


class _Search:
    """The ``k`` best of a block of rows for each of a block of queries; all rows are compared exactly where there are no codes."""

    def __init__(self, k: int, c: np.ndarray | None = None, p: np.ndarray | None = None, width: float = WIDTH):
        self.k, self.c, self.p, self.width = k, c, p, width

    def __call__(self, asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        one = lambda t, name: t.column(name).combine_chunks()
        dim = len(one(rows, "v")[0])
        q, x = _matrix(one(asks, "q"), dim), _matrix(one(rows, "v"), dim)
        asker, query = one(asks, "asker").to_numpy(), one(asks, "query_id").to_numpy()
        row, vec = one(rows, "row").to_numpy(), one(rows, "vec_id").to_numpy()
        order = np.lexsort((row, vec))  # ties go to the smaller vec_id
        x, row, vec = x[order], row[order], vec[order]
        estimate = self.limits(rows.take(pa.array(order))) if self.p is not None else None
        k, out = min(self.k, len(x)), []
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            own = asker[start : start + 256, None] == row[None, :]
            if estimate is None:
                good = ~own
            else:
                value, bound = estimate(part)
                least = -np.partition(-np.where(own, -np.inf, value - bound), k - 1, axis=1)[:, k - 1 : k]
                good = (value + bound >= least) & ~own
            for i in range(len(part)):
                at = np.flatnonzero(good[i])
                exact = (x[at] * part[i]).sum(axis=1)
                best = np.argsort(-exact, kind="stable")[: self.k]
                out.append((np.full(len(best), asker[start + i]), np.full(len(best), query[start + i]), row[at[best]], vec[at[best]], exact[best]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)

    def limits(self, rows: pa.Table):
        """A function from queries to estimates and their error bounds, for these rows of one cluster.

        The bits of a block are unpacked to signs for one matrix product, the cheapest way to add them up in numpy.
        """
        one = lambda name: rows.column(name).combine_chunks()
        bits = self.p.shape[1]
        norm, own = one("norm").to_numpy(), np.maximum(one("own").to_numpy(), 1e-9)
        packed = np.frombuffer(b"".join(one("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        signs = np.unpackbits(packed, axis=1)[:, :bits].astype(np.float32) * 2 - 1
        centroid = self.c[one("cluster")[0].as_py()]
        scale = norm / (own * np.sqrt(bits))
        spread = norm * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(bits - 1) * self.width
        return lambda q: ((q @ centroid)[:, None] + ((q @ self.p).astype(np.float32) @ signs.T) * scale, np.linalg.norm(q, axis=1)[:, None] * spread + 1e-5)


_FOUND = pa.schema([("asker", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "asker long, query_id long, row long, vec_id long, score double"


def _in_blocks(asks: DataFrame, rows: DataFrame, counts: DataFrame, keys: list[str], search: _Search) -> DataFrame:
    """Every block of rows of a key with every block of queries of it; counts: keys, row_blocks, query_blocks."""
    lot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    drop = ("row_blocks", "query_blocks")
    rows = rows.join(counts, keys).where("query_blocks > 0").select("*", lot("row", "row_blocks").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb")).drop(*drop)
    asks = asks.join(counts, keys).where("row_blocks > 0").select("*", lot("asker", "query_blocks").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb")).drop(*drop)
    by = [*keys, "rb", "qb"]
    return asks.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(lambda a, b: search(a, b), _FOUND_DDL)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, probes: int = PROBES, sample_rows: int = SAMPLE_ROWS, block: int = BLOCK, width: float = WIDTH, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by inner product of the vectors whose vec_id ``every`` divides.

    Vectors null, zero, or with null or non-finite components take no part, nor do rows with a null vec_id.  All rows but
    the query's own are its candidates, those that repeat its vec_id too; a query's row that repeats is a query again.
    Ties go to the smaller vec_id.  An inner product takes two vectors of one dimension: those of another than the most
    frequent one are compared with their like alone, all of them.  Fewer candidates give all of them where the clusters
    probed hold them: clusters are added until they hold ``LEAST_ROWS`` rows.  At least ``probes`` clusters are probed, and
    as many more as ``probes_needed`` finds, so the share of the table that is searched follows from the data.  ``exact``:
    all clusters, all rows, no estimates.  An empty table gives an empty one.  Only vec_id and embedding are read, from an
    input that must be read alike each time.

    Broadcast are the centroids, half the root of the number of rows, and the rotation; the driver also gets a sample of
    vectors (16 a centroid, ``sample_rows`` at least, 32 MB at most, which bounds the centroids too), the trial queries and
    the clusters' sizes.
    """
    spark = vectors.sparkSession
    own, dim, kind = usable(vectors)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    like, others = own.where(F.size("v") == dim), own.where(F.size("v") != dim)
    total = like.count()
    most = max(256, SAMPLE_BYTES // (8 * dim))
    clusters = max(1, min(round(total**0.5 / 2), most // SAMPLE_PER_CLUSTER))
    sample = like.orderBy(F.xxhash64("vec_id"), "row").limit(min(most, max(sample_rows, SAMPLE_PER_CLUSTER * clusters))).select("v").toArrow().column("v").combine_chunks()
    sample = _matrix(sample, dim)
    c, p = centroids(sample, min(clusters, len(sample))), projection(dim)
    index = cut(like.mapInArrow(_Encode(c, p), f"row long, vec_id long, v {kind}, cluster int, code binary, norm float, own float"))
    sizes = np.zeros(len(c), np.int64)
    for r in index.groupBy("cluster").count().collect():
        sizes[r["cluster"]] = r["count"]
    queries = index.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v")
    if exact:
        probes = len(c)
    elif probes < len(c):
        probes = max(probes, probes_needed(index, queries, c, k))
    asks = queries.mapInArrow(_Route(c, sizes, probes, LEAST_ROWS), f"asker long, query_id long, q {kind}, cluster int")
    asked = {r["cluster"]: r["count"] for r in asks.groupBy("cluster").count().collect()}
    counts = F.broadcast(spark.createDataFrame([(i, -(-int(n) // block), -(-asked.get(i, 0) // block)) for i, n in enumerate(sizes)], "cluster int, row_blocks int, query_blocks int"))
    found = _in_blocks(asks, index, counts, ["cluster"], _Search(k) if exact else _Search(k, c, p, width))
    if not others.isEmpty():
        rows = cut(others.withColumn("dim", F.size("v")))
        ask = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.expr("dim + 0").alias("dim"))
        blocks_of = lambda df, name: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
        few = blocks_of(rows, "row_blocks").join(blocks_of(ask, "query_blocks"), "dim")
        found = found.unionByName(_in_blocks(ask, rows, few, ["dim"], _Search(k)))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
