"""Embedding whitening: blockwise QR of centred rows, then a qd solver for the small factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occugrid.llm import qd
from occugrid.storage import written_table

#: Fixed-point grid on which vectors count as equal and sums are exact.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Triangular factors that one task stacks at a time.
FAN_IN = 16
#: Dimensions at most: the driver holds a factor of that square (32 MB).
MAX_DIMS = 2_048


@dataclass(frozen=True)
class Whitening:
    """A whitening of fixed-point vectors: ``(x - sums / n) @ directions / sqrt(variances)``."""

    n: int
    sums: tuple[int, ...]
    #: Unit directions as columns, by falling variance.
    directions: np.ndarray
    variances: np.ndarray
    #: Sum of all variances.
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as 64-bit integers where they hold it, else as Python's."""
        sums = np.array(self.sums, object)
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most < 1 << 62:
            return x * self.n - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less their mean, rounded once."""
        return self.deviations(x).astype(np.float64) / max(self.n, 1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.variances)

    def squares(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of the squared deviations, exact."""
        d = self.deviations(x)
        if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 62:
            d = d.astype(object)
        return [int(one) for one in (d * d).sum(axis=1)]


def fixed_point(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``(id, x)``: every entry ``c`` becomes the long ``floor(scale * c) + offset``.

    Rows whose vector is null or holds a null, NaN or infinite entry are dropped. Null ids and
    repeated rows are kept; an empty vector stays empty. Other columns are not read.
    """
    entries = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    # Of a null vector the test is null, too.
    sound = ~F.exists("entries", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite))
    grid = F.transform("entries", lambda c: F.floor(c * scale) + F.lit(offset).cast("long"))
    known = rows.select(F.col(id_col).alias("id"), entries.alias("entries"))
    return known.where(sound).select("id", grid.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def _factors(rows: DataFrame, model: Whitening) -> DataFrame:
    """``(part, factor)``: the triangular QR factor of the centred rows of each task."""
    dims = len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dims))
        for batch in batches:
            centred = shared.value.centred(_matrix(batch["x"], dims))
            factor = np.linalg.qr(np.concatenate([factor, centred]), mode="r")
        yield _as_row(factor, dims)

    reduced = rows.select("x").mapInArrow(reduce, "factor binary")
    return reduced.select(F.spark_partition_id().alias("part"), "factor")


def _as_row(factor: np.ndarray, dims: int) -> pa.RecordBatch:
    whole = np.zeros((dims, dims))
    whole[: len(factor)] = factor
    return pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["factor"])


def _stacked(factors: DataFrame, dims: int) -> DataFrame:
    """Factors of ``FAN_IN`` neighbours as one."""

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, factor = None, np.zeros((0, dims))
        for batch in batches:
            for number, raw in zip(batch["part"].to_pylist(), batch["factor"].to_pylist(), strict=True):
                if part is not None and number != part:
                    yield with_part(part, factor)
                    factor = np.zeros((0, dims))
                part = number
                other = np.frombuffer(raw).reshape(dims, dims)
                factor = np.linalg.qr(np.concatenate([factor, other]), mode="r")
        if part is not None:
            yield with_part(part, factor)

    def with_part(part: int, factor: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), _as_row(factor, dims)["factor"]], names=["part", "factor"]
        )

    grouped = factors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    ordered = grouped.repartition("part").sortWithinPartitions("part")
    return ordered.mapInArrow(stack, "part int, factor binary")


def triangular_factor(rows: DataFrame, model: Whitening) -> np.ndarray:
    """``R`` of the QR decomposition of all centred rows: one factor per task, stacked in a tree."""
    dims = len(model.sums)
    factors = written_table(_factors(rows, model), "qr-factors")
    while factors.count() > FAN_IN:
        factors = written_table(_stacked(factors, dims), "qr-factors")
    # At most FAN_IN factors, in a fixed order.
    last = [np.frombuffer(row.factor).reshape(dims, dims) for row in factors.orderBy("part").collect()]
    return np.linalg.qr(np.concatenate([*last, np.zeros((dims, dims))]), mode="r")


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """``(model, fit list)``: whitening directions of the distinct vectors ``x`` of ``fixed_point``.

    The fit list is each distinct vector once, in a table that is written; repeated vectors are
    combined before they are shuffled. Sums are exact whole numbers. The centred rows are reduced
    to one small triangular factor by blocks; its singular values, squared and over ``n``, are
    the variances. Directions within rounding of no variance are left out, so equal vectors, or
    fewer than the components, give fewer of them; an empty list gives none.

    All vectors must have one length of at most ``MAX_DIMS``; others are refused.
    """
    distinct = written_table(vectors.select("x").distinct(), "distinct-vectors")
    # One row.
    n, least, most = distinct.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most or (most or 0) > MAX_DIMS:
        raise ValueError(f"vectors must have one length up to {MAX_DIMS}, not {least} to {most}")
    dims = most or 0
    empty = Whitening(n, (0,) * dims, np.zeros((dims, 0)), np.zeros(0), 0.0)
    if not dims:
        return empty, distinct
    model = Whitening(n, _sums(distinct, dims), empty.directions, empty.variances, 0.0)
    squared, directions = qd.right_singular(triangular_factor(distinct, model), components)
    variances = squared[: directions.shape[1]] / n
    return Whitening(n, model.sums, directions, variances, float(squared.sum()) / n), distinct


def _sums(rows: DataFrame, dims: int) -> tuple[int, ...]:
    """Exact sum of each dimension: whole numbers added in tasks, then by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = _matrix(batch["x"], dims)
            exact = x if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, exact.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([str(one) for one in total])], names=["dim", "total"]
        )

    parts = rows.select("x").mapInArrow(add, "dim int, total string")
    sums = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # One row for each dimension.
    return tuple(int(row.total) for row in sums.orderBy("dim").collect())


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, as measured.

    One pass over the fit list; each task hands on one small matrix. 0 without components.
    """
    k, dims = model.directions.shape[1], len(model.sums)
    if not k:
        return 0.0
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = shared.value.whitened(_matrix(batch["x"], dims))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"]
        )

    parts = distinct.select("x").mapInArrow(multiply, "place int, value double")
    sums = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    total = np.array([row.value for row in sums]).reshape(k + 1, k) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(covariance - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``(id, whitened, deviation)``: whitened coordinates of every row, and its exact distance.

    ``deviation`` is the sum over the dimensions of ``(n * x - sums) ** 2``, a decimal of up to
    38 digits. Null ids and repeated rows are kept. No shuffle.
    """
    dims = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], dims)
            w = shared.value.whitened(x)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch["id"], lists, pa.array(map(str, shared.value.squares(x)), pa.string())],
                names=["id", "whitened", "deviation"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    found = vectors.mapInArrow(whiten, f"id {kind}, whitened array<double>, deviation string")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def components(transformed: DataFrame, model: Whitening, error: float, id_col: str = "vec_id") -> DataFrame:
    """A row for each row and component: ``(id, component, n, deviation, whitened, explained,
    identity_error)``. A deviation that no long holds is null. Null ids and repeated rows are kept;
    without components there are no rows.
    """
    shares = [float(one) for one in model.variances / model.trace] if model.trace else []
    explained = F.array(*[F.lit(one) for one in shares]).cast("array<double>")
    deviation = F.col("deviation").try_cast("long").alias("deviation")
    return transformed.select(
        F.col("id").alias(id_col), deviation, F.posexplode("whitened").alias("place", "whitened")
    ).select(
        id_col,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
