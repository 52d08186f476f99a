"""Operator 12: whitening of embeddings by Chan's merging of centred moments.

Each partition computes its vectors' count, exact sums and centred scatter, batch by
batch; two such states merge by the pairwise formula, in a tree over the partitions.
The driver holds one state (dims^2 numbers) and takes its eigenvectors.  A second pass
projects every vector and merges the same moments of the projections, whose covariance
must be the identity; the largest difference is returned.

Entries c become the long x = floor(1024 * c) + 100000; the offset is far above the
spread, so everything is centred before it is multiplied, and sums stay integers.

Rows whose vector is null or holds a null or non-finite entry take no part; nor do
those with an entry of 2^42 or more, which has no exact x, or with another length than
the commonest (the smaller of equally common ones).  Repeated rows and vec_ids each count; a null vec_id is
kept.  Components whose eigenvalue is zero to working precision have no whitened form and
are left out: all equal vectors, or a single one, give no rows.  Empty tables give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recallforge.llm import _io

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
#: Entries from here on have no exact long form.
LARGEST = 2.0**42
#: States that one task of the tree merges.
FAN_IN = 16
_STATE = "n long, sums binary, scatter binary"
_LONG = (1 << 63) - 1


@dataclass
class Moments:
    """Count, exact sums and centred scatter of vectors of ``dims`` entries."""

    n: int
    sums: list[int] | list[float]
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of ``x``; sums of integers stay Python's integers."""
        sums = x.sum(axis=0).tolist()
        centred = x - np.array([s / len(x) for s in sums])
        return cls(len(x), sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean() - self.mean()
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter)

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _quantised(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64) + OFFSET


def _packed(m: Moments | None) -> pa.RecordBatch:
    """One row; the sums as decimal text, for they may pass 64 bits."""
    rows = [] if m is None else [m]
    sums = [",".join(map(repr, r.sums)).encode() for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r.n for r in rows], pa.int64()), pa.array(sums, pa.binary()), pa.array([r.scatter.tobytes() for r in rows], pa.binary())], names=["n", "sums", "scatter"])


def _unpacked(row) -> Moments:
    sums = [float(s) if "." in s or "e" in s else int(s) for s in bytes(row.sums).decode().split(",")]
    return Moments(row.n, sums, np.frombuffer(bytes(row.scatter)).reshape(len(sums), len(sums)))


def _moments(vectors: DataFrame, dims: int, form) -> Moments:
    """Moments of ``form(batch of vectors)`` over all partitions."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = Moments.of(form(_vectors(batch.column("v"), dims)))
                total = one if total is None else total.merged(one)
        yield _packed(total)

    states = vectors.select("v").mapInArrow(local, _STATE).rdd.map(_unpacked)
    depth = max(2, math.ceil(math.log(max(2, states.getNumPartitions()), FAN_IN)))
    return states.treeReduce(lambda a, b: a.merged(b), depth)


def valid(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """(key, v) of the rows that take part, and their length (0: there is none)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{key}`").alias("key"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce((c > -LARGEST) & (c < LARGEST), F.lit(False))))
    sizes = rows.groupBy(F.size("v").alias("dims")).count()
    most = sizes.orderBy(F.desc("count"), "dims").first()
    return (rows, 0) if most is None else (rows.where(F.size("v") == most.dims), most.dims)


class Whitening:
    """Mean and projection of a fitted table."""

    def __init__(self, m: Moments, components: int):
        self.n, self.sums, self.mean = m.n, m.sums, m.mean()
        values, vectors = np.linalg.eigh(m.covariance())
        values, vectors = values[::-1], vectors[:, ::-1]
        real = values > max(values[0], 0) * len(values) * np.finfo(float).eps
        keep = min(components, int(real.sum()))
        self.values, self.vectors = values[:keep], vectors[:, :keep]
        self.trace = float(np.trace(m.covariance()))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        """Whitened projections of vectors."""
        return (_quantised(v) - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 of each row, exactly."""
        reach = max([abs(self.n * int(e) - s) for row in (x.min(axis=0), x.max(axis=0)) for e, s in zip(row.tolist(), self.sums, strict=True)])
        if reach * reach * x.shape[1] <= _LONG and max(map(abs, self.sums)) <= _LONG and self.n * int(abs(x).max()) <= _LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return (d * d).sum(axis=1).tolist()


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``vectors`` (v), all of length ``dims``."""
    return Whitening(_moments(vectors, dims, _quantised), components)


def identity_error(vectors: DataFrame, dims: int, w: Whitening) -> float:
    """The largest entry of the difference between the whitened covariance and the identity."""
    return float(abs(_moments(vectors, dims, w).covariance() - np.eye(len(w.values))).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, n, deviation decimal(38,0), whitened (a list, by component), explained (a
    list), identity_error of each row that takes part."""
    vectors, dims = valid(embeddings, vector, key)
    kind = vectors.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    w = fit(vectors, dims, components)
    if not len(w.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(vectors, dims, w), (w.values / w.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, rows = _vectors(batch.column("v"), dims), batch.num_rows
            if not rows:
                continue
            far = pa.array(w.deviations(_quantised(v)), pa.decimal128(38, 0))
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * len(w.values))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (w(v), np.tile(explained, (rows, 1)))]
            same = [pa.array(np.full(rows, x)) for x in (w.n, error)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), same[0], far, *lists, same[1]], names=["key", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits (some 3 million vectors of 64 entries and unit length) is null here; the
    operator's decimal holds it."""
    rows = whiten(_io.table(spark, sf_dir, "embeddings"))
    each = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        F.col("key").cast("long").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
