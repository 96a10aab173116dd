"""Embedding whitening (13): principal components of embeddings, scaled to unit variance.

Entries become whole numbers, floor(256 c), and every distinct vector counts once
in the fit. Spark sums them, and then sums the products of the vectors less the
rounded mean: those products are whole numbers, so their sums are exact up to 2^53
and the same for any partitioning. What reaches the driver is one number per pair
of dimensions. There the scatter about the true mean is factored by Cholesky with
pivots, one-sided Jacobi rotations make the factor's columns orthogonal, and their
squared lengths are the eigenvalues, the columns scaled to length one the
components. Small eigenvalues keep their relative accuracy this way.

Defined cases: rows whose vector is null or holds null or non-finite entries are
dropped; a shorter vector counts as if zeros followed; the id column is passed on
as it is, nulls and repeats included, and repeated rows each have their own result;
directions without variance have no component, so that one distinct vector, or
none, gives no rows; equal eigenvalues come in any order, the same for all rows.
``deviation`` is null where it is beyond 64 bits. Entries beyond 2^55 in size are
read as 2^63 after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import cut, ship

SCALE = 256
COMPONENTS = 4
# Columns count as orthogonal, and pivots as zero, below these parts of their sizes.
_ORTHOGONAL = 1e-15
_EMPTY = 1e-13


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column) -> Column:
    """Entries as whole numbers: floor(256 c)."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``L`` with ``matrix = L @ L.T``, a column per pivot; the largest remaining diagonal entry is the next pivot."""
    rest, size = matrix.astype(np.float64).copy(), len(matrix)
    columns, most = [], float(np.max(np.diag(rest), initial=0.0))
    for _ in range(size):
        pivot = int(np.argmax(np.diag(rest)))
        if rest[pivot, pivot] <= _EMPTY * most:
            break
        column = rest[:, pivot] / np.sqrt(rest[pivot, pivot])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0.0
    return np.array(columns).T if columns else np.zeros((size, 0))


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, as rounds of disjoint pairs: one place stays, the others move on around it."""
    even = size + size % 2
    ring = np.arange(even)
    for _ in range(even - 1):
        left, right = ring[: even // 2], ring[even // 2 :][::-1]
        there = np.maximum(left, right) < size
        yield np.minimum(left, right)[there], np.maximum(left, right)[there]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal, longest column first."""
    turned = factor.copy()
    for _ in range(sweeps):
        moved = False
        for p, q in _rounds(turned.shape[1]):
            a, b = turned[:, p], turned[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            skew = np.abs(ab) > _ORTHOGONAL * np.sqrt(aa * bb)
            if not skew.any():
                continue
            moved = True
            ratio = (bb - aa) / (2 * np.where(skew, ab, 1.0))
            tangent = np.where(skew, np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio)), 0.0)
            cosine = 1 / np.hypot(1.0, tangent)
            sine = cosine * tangent
            turned[:, p], turned[:, q] = cosine * a - sine * b, sine * a + cosine * b
        if not moved:
            break
    return turned[:, np.argsort(-(turned * turned).sum(0), kind="stable")]


@dataclass
class Whitening:
    """What a fit knows: count and sums of the distinct vectors, components as columns, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray, count: int) -> np.ndarray:
        """Rows of ``x`` on the first components, each of unit variance over the fit."""
        return self.centred(x) @ (self.components[:, :count] / np.sqrt(self.values[:count]))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A row per list, filled up with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == size).all():
        return flat.reshape(len(ends), size)
    rows, before = np.repeat(np.arange(len(ends)), ends), np.cumsum(ends) - ends
    out = np.zeros((len(ends), size), dtype=np.int64)
    out[rows, np.arange(len(flat)) - before[rows]] = flat
    return out


def _products(shift: list[int]):
    """The task's sums of products of shifted vectors, a row per dimension."""
    schema = pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(shift), len(shift)))
        for batch in batches:
            shifted = (_matrix(batch.column(0), len(shift)) - np.array(shift, dtype=np.int64)).astype(np.float64)
            total += shifted.T @ shifted
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(shift)), pa.int32()), pa.array(list(total), schema.types[1])], schema=schema)

    return run


def _entries(parts: DataFrame, size: int) -> np.ndarray:
    """The sum over tasks of matrices given by rows."""
    summed = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for row in summed.toLocalIterator():
        out[row.i, row.j] = row.v
    return out


def fit(distinct: DataFrame) -> Whitening | None:
    """Fit on a table of distinct vectors ``x`` of whole numbers; ``None`` if it is empty."""
    ship(distinct.sparkSession)
    n = distinct.count()
    sums: dict[int, int] = {}
    for row in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).toLocalIterator():
        sums[row.i] = int(row.s)
    if not n or not sums:
        return None
    size = max(sums) + 1
    totals = [sums.get(i, 0) for i in range(size)]
    shift = [(2 * s + n) // (2 * n) for s in totals]
    scatter = _entries(distinct.select("x").mapInArrow(_products(shift), "i int, sums array<double>"), size)
    off = np.array([(s - n * m) / n for s, m in zip(totals, shift, strict=True)])
    covariance = scatter / n - np.outer(off, off)
    turned = orthogonal_columns(pivoted_cholesky(covariance))
    values = (turned * turned).sum(0)
    components = turned / np.sqrt(values)
    # One sign for all: a component's largest entry is positive.
    if components.shape[1]:
        top = components[np.argmax(np.abs(components), axis=0), np.arange(components.shape[1])]
        components = components * np.sign(top)
    return Whitening(n, totals, components, values, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening, count: int) -> float:
    """Largest entry of the whitened vectors' covariance over the fit, less the identity, in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count + 1))
        for batch in batches:
            white = model.project(_matrix(batch.column(0), model.size), count)
            total[:, :count] += white.T @ white
            total[:, count] += white.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    summed = _entries(distinct.select("x").mapInArrow(run, "i int, sums array<double>"), count + 1)[:count]
    mean = summed[:, count] / model.n
    return float(np.max(np.abs(summed[:, :count] / model.n - np.outer(mean, mean) - np.eye(count)), initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact."""
    most = n * int(np.max(np.abs(x), initial=0)) + max(map(abs, sums))
    if most * most * len(sums) < 2**63:
        spread = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        return (spread * spread).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable row and component."""
    kind = vectors.schema[key]
    out = T.StructType([
        T.StructField(key, kind.dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    rows = vectors.where(usable(F.col(column))).select(F.col(key).alias("_key"), scaled(F.col(column)).alias("x"))
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))))
    distinct = cut(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct)
    count = min(components, len(model.values)) if model else 0
    if not count:
        return vectors.sparkSession.createDataFrame([], out)
    error = identity_error(distinct, model, count)
    explained = (model.values[:count] / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), model.size)
            times = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(times), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), times)),
                    pa.array(np.full(times * count, model.n, dtype=np.int64)),
                    pa.array([d for d in _deviations(x, model.n, model.sums) for _ in range(count)], pa.int64()),
                    pa.array(model.project(x, count).reshape(-1)),
                    pa.array(np.tile(explained, times)),
                    pa.array(np.full(times * count, error)),
                ],
                names=out.names,
            )

    return rows.mapInArrow(run, out)
