"""Whitening of embeddings by two passes over the vectors.

An entry c becomes the integer x = floor(1024 c) + 100000. The first pass adds these up exactly
by dimension, as decimals in Spark's own aggregation, which gives n and the sums S. In the second each
task centres its vectors, x - S/n, before it multiplies them, and adds up their outer products
by matrix products of batches; treeAggregate merges the tasks' matrices, so that the driver
gets few. The driver takes the eigenvectors of the one matrix, whose size is the square of the
number of dimensions, and broadcasts the projection on the first components, each divided by
the root of its eigenvalue. A third pass measures the covariance of what the projection gives.

Defined cases: a vector that is null or holds a null, an infinity or no number takes no part and
gives no row; entries that lack at the end of a vector shorter than the longest count as 0;
x beyond 2^52 counts as 2^52, for either sign; of the two signs of a component the one in which
its largest entry, the first of equal ones, is positive; equal eigenvalues leave their components
to the LAPACK routine; a component whose eigenvalue is nought to double precision, as with equal
vectors or fewer vectors than dimensions, has null for whitened, and takes no part in the error;
null and repeated ids are kept, a row each; an empty table, and one of empty vectors, gives an
empty result; other columns are kept by whiten().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import aside

SCALE, SHIFT, LARGEST, COMPONENTS = 1024, 100_000, 1 << 52, 8


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its entries are numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def digits(vectors: DataFrame, column: str) -> DataFrame:
    """``vectors`` that take part, with their integers as _x."""
    x = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE) + SHIFT, F.lit(LARGEST)), F.lit(-LARGEST))
    # beyond it the sum could leave the range of a long
    near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(2.0**50)), F.lit(-(2.0**50)))
    return vectors.where(finite(F.col(column))).withColumn("_x", F.transform(column, lambda c: x(near(c)).cast("long")))


def batch_of(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims``."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(at)
    out = np.full((len(sizes), dims), SHIFT, np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""
    each = F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "_x")).alias("at", "x")  # the first place counts rows
    got = rows.select(each).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s")).collect()
    by = {r["at"]: r for r in got}
    n = by[0]["n"] if by else 0
    return n, [int(by[i]["s"]) + (n - by[i]["n"]) * SHIFT for i in range(1, len(by))]


def times_n(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: as machine integers where they are sure to hold it, else as Python's."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, total), default=0) >= 1 << 62:
        x = x.astype(object)
    return x * n - np.array(total, x.dtype)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (times_n(x, n, total) / n).astype(np.float64)


def squares(y: np.ndarray) -> list[Decimal]:
    """The sum of squares of each row of integers, exactly."""
    if max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 * max(1, y.shape[1]) >= 1 << 63:
        y = y.astype(object)
    return [Decimal(int(v)) for v in (y * y).sum(axis=1)]


def outer_sum(rows: DataFrame, dims: int, make) -> np.ndarray:
    """The sum over all rows of the products of ``make`` of their integers with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = make(batch_of(batch.column(0), dims))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(a: np.ndarray | None, b) -> np.ndarray:
        b = np.frombuffer(b[0], np.float64) if isinstance(b, tuple) else b
        return a if b is None else b if a is None else a + b

    parts = rows.select("_x").mapInArrow(run, "total binary").rdd.map(tuple)
    out = parts.treeAggregate(None, add, add, 3)
    k = 0 if out is None else int(len(out) ** 0.5)
    return np.zeros((0, 0)) if out is None else out.reshape(k, k)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    projection: np.ndarray  # dimensions x components
    known: np.ndarray  # whether a component's eigenvalue is above nought
    explained: list[float]
    error: float | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.projection


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Of the rows of digits()."""
    n, total = sums(rows)
    if not total:
        return None
    dims = len(total)
    values, vectors = np.linalg.eigh(outer_sum(rows, dims, lambda x: centred(x, n, total)) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    whole = float(values.sum())
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)]
    vectors, first = vectors * np.where(largest < 0, -1.0, 1.0), slice(min(components, dims))
    known = values > values[0] * dims * np.finfo(float).eps
    scale = np.where(known, 1 / np.sqrt(np.where(known, values, 1.0)), 0.0)
    out = Whitening(n, total, (vectors * scale)[:, first], known[first], [max(float(v), 0.0) / whole if whole > 0 else 0.0 for v in values[first]])
    if out.known.any():
        got = outer_sum(rows, dims, lambda x: out(x)[:, out.known]) / n  # their mean is nought, as vectors were centred
        out.error = float(np.abs(got - np.eye(len(got))).max())
    return out


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vectors`` that take part, with n, explained (array), identity_error, deviation (decimal) and whitened (array)."""
    made = ("n", "deviation", "whitened", "explained", "identity_error")
    rows, back = aside(vectors, column)
    rows = digits(rows, column)
    model = fit(rows, components)
    kept = rows.select(*back(*made), "_x")
    if model is None:
        return kept.limit(0).select(*(F.col(f"`{c}`") for c in kept.columns[:-1]), *(F.lit(None).cast(t).alias(c) for c, t in zip(made, ("long", "decimal(38,0)", "array<double>", "array<double>", "double"))))
    shared, dims = rows.sparkSession.sparkContext.broadcast(model), len(model.sums)  # of dimensions x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = batch_of(batch.column(batch.num_columns - 1), dims)
            far = pa.array([d if d < 10**38 else None for d in squares(times_n(x, own.n, own.sums))], pa.decimal128(38, 0))
            z = own(x)
            z = pa.array(z.reshape(-1), mask=np.tile(~own.known, len(z)))
            z = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(own.known), pa.int32()), z)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], far, z], [*batch.schema.names[:-1], "deviation", "whitened"])

    names = {c: f"c{i}" for i, c in enumerate(kept.columns[:-1])}
    slim = kept.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), "_x")
    kind = ", ".join([f"{n} {slim.schema[n].dataType.simpleString()}" for n in names.values()] + ["deviation decimal(38,0)", "whitened array<double>"])
    out = slim.mapInArrow(run, kind)
    return out.select(
        *(F.col(n).alias(c) for c, n in names.items()),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, model.explained)).alias("explained"),
        F.lit(model.error).cast("double").alias("identity_error"),
    )


def op12_whiten(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    rows = whiten(vectors).select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("_at")).alias("explained"), "identity_error")


QUERIES = {"op12_whiten": op12_whiten}
ORACLES: dict = {}
