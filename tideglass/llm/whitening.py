"""Embedding whitening: leading eigenvectors of the covariance by LOBPCG, products distributed over centred rows.

Vectors become whole numbers x = floor(256 * entry); the fit list holds each distinct x once. An iteration multiplies
the covariance with an orthonormal basis of the span of iterate, residual and previous direction blocks, in one pass
over the fit list whose tasks send d rows of block width, summed before they reach the driver: what the driver holds
is a few d x block matrices, whatever the number of rows. Rayleigh-Ritz on the basis gives the next iterate, and with
the same products its residuals. They are certified before use: the leading ones must fall below TOLERANCE times the
largest eigenvalue, or the operator raises an error.

Definitions. Vectors that are null or hold null, NaN or infinite entries are dropped. Vectors shorter than the longest
are taken as ended by zeros, so an empty one is all zeros. Repeated rows come back once each. Components are those
of eigenvalues above RANK times the largest, so fewer than k where the rank is lower, none where all vectors are equal.
Deviations beyond a long are null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import staged

#: Vectors of the iterate: the components asked for and guards that speed up convergence.
BLOCK = 32
#: Largest residual of a component, of the largest eigenvalue; least eigenvalue of a component, of the largest.
TOLERANCE, RANK = 1e-13, 1e-12
_ROUNDS = 500


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors that hold finite entries alone."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    return sound.select("vec_id", F.transform("v", lambda c: F.floor(c * 256)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of whole numbers, ended by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, int)])] = flat
    return out


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """The sum of each dimension, and the number of rows as dimension -1."""
    total, n = np.zeros(d, object), 0
    for batch in batches:
        x = _matrix(batch.column(0), d)
        wide = x.size and max(abs(int(x.min())), abs(int(x.max()))) > (1 << 62) // len(x)
        total += x.astype(object).sum(axis=0) if wide else x.sum(axis=0).astype(object)
        n += len(x)
    values = [n, *total]
    from decimal import Decimal

    yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["i", "total"])


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Row i: the sums over rows y of y[i] * (y . basis), and last of y[i] squared."""
    d, m = basis.shape
    total = np.zeros((d, m + 1))
    for batch in batches:
        y = _matrix(batch.column(0), d) - mean
        total[:, :m] += y.T @ (y @ basis)
        total[:, m] += (y * y).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])


def _gathered(fit: DataFrame, kernel, d: int, m: int) -> np.ndarray:
    """The d x m sums of the tasks' rows (i, sums)."""
    parts = fit.select("x").mapInArrow(kernel, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "part"))
    out = np.zeros((d, m))
    for i, j, total in parts.groupBy("i", "j").agg(F.sum("part")).collect():
        out[i, j] = total
    return out


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's columns, without those that depend on others or on `against`."""
    for _ in range(2):  # twice is enough
        if against is not None:
            block = block - against @ (against.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    return block


def eigenvectors(fit: DataFrame, n: int, mean: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(values, vectors as columns, trace, largest residual) of the covariance of fit (x): its k largest eigenvalues, by LOBPCG."""
    d = len(mean)
    m = min(d, max(BLOCK, 2 * k))
    basis, previous = _orthonormal(np.random.default_rng(0).standard_normal((d, m))), None
    for _ in range(_ROUNDS):
        found = _gathered(fit, partial(_products, mean=mean, basis=basis), d, basis.shape[1] + 1) / n
        product, trace = found[:, :-1], float(found[:, -1].sum())
        ritz = basis.T @ product
        values, mix = np.linalg.eigh((ritz + ritz.T) / 2)
        values, mix = values[::-1][:m], mix[:, ::-1][:, :m]
        iterate, image = basis @ mix, product @ mix
        residual = image - iterate * values
        largest = float(np.linalg.norm(residual[:, :k], axis=0).max(initial=0.0))
        if largest <= TOLERANCE * max(values[0], 0.0) or not trace:
            return values[:k], iterate[:, :k], trace, largest
        before = previous if previous is not None else np.zeros((d, 0))
        direction = iterate - before @ (before.T @ iterate) if before.shape[1] else np.zeros((d, 0))
        previous = iterate
        basis = np.concatenate([iterate, _orthonormal(residual, iterate)], axis=1)
        basis = np.concatenate([basis, _orthonormal(direction, basis)], axis=1)
    raise ArithmeticError(f"residual {largest:.3g} after {_ROUNDS} rounds")


def _whiten(batches: Iterator[pa.RecordBatch], id_name: str, n: int, sums: list[int], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, x) to (vec_id, component, deviation, whitened)."""
    d, k = axes.shape
    mean = np.array([s / n for s in sums])
    exact = np.array(sums, object)
    for batch in batches:
        x = _matrix(batch.column(1), d)
        y = x - mean
        if len(x) and float(n) ** 2 * float((y * y).sum(axis=1).max()) > 2.0**60:
            wide = ((n * x.astype(object) - exact) ** 2).sum(axis=1)
            deviation = [int(v) if v < 1 << 63 else None for v in wide]
        else:
            deviation = ((n * x - exact.astype(np.int64)) ** 2).sum(axis=1)
        turned = y @ axes
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.repeat(np.array(deviation, object), k), pa.int64()),
                pa.array(turned.ravel()),
            ],
            [id_name, "component", "deviation", "whitened"],
        )


def _gram(batches: Iterator[pa.RecordBatch], mean: np.ndarray, axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Row i: the sums of whitened[i] * whitened, and last of whitened[i]."""
    d, k = axes.shape
    total = np.zeros((k, k + 1))
    for batch in batches:
        w = (_matrix(batch.column(0), d) - mean) @ axes
        total[:, :k] += w.T @ w
        total[:, k] += w.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])


class Whitening:
    """What fit() learns: n, the sums S, eigenvalues, eigenvectors as columns, the trace, the certified residual and the identity error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, residual: float, identity_error: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace, self.residual, self.identity_error = n, sums, values, vectors, trace, residual, identity_error

    @property
    def axes(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, k: int = 4) -> Whitening | None:
    """Learns from whole(vectors); None where there is no row."""
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return None
    # shorter vectors are ended by zeros before they are compared
    padded = F.when(F.size("x") < d, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))).otherwise(F.col("x"))
    distinct = staged(rows.select(padded.alias("x")).groupBy("x").agg(F.lit(1)).select("x"))
    sums = distinct.mapInArrow(partial(_sums, d=d), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total"))
    by = {r["i"]: int(r["total"]) for r in sums.collect()}
    n, total = by[-1], [by[i] for i in range(d)]
    if not d:
        return Whitening(n, total, np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0)
    mean = np.array([s / n for s in total])
    values, vectors, trace, residual = eigenvectors(distinct, n, mean, k)
    some = values > RANK * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    model = Whitening(n, total, values, vectors, trace, residual, 0.0)
    if len(values):
        found = _gathered(distinct, partial(_gram, mean=mean, axes=model.axes), len(values), len(values) + 1) / n
        covariance = found[:, :-1] - np.outer(found[:, -1], found[:, -1])
        model.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of whole(vectors), a row for each component."""
    fields = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, deviation bigint, whitened double"
    if model is None or not len(model.values):
        found, shares = rows.sparkSession.createDataFrame([], fields), F.lit(0.0)
    else:
        found = rows.mapInArrow(partial(_whiten, id_name="vec_id", n=model.n, sums=model.sums, axes=model.axes), fields)
        shares = F.get(F.array(*(F.lit(float(v / model.trace)) for v in model.values)), F.col("component") - 1)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
