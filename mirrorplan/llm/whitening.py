"""Whitening of embeddings by their leading principal components.

A vector's entry c becomes the integer floor(64 c) + 1000000. The fit list holds each distinct integer vector once. Its
covariance is summed on Spark in integers, centred at the rounded mean before anything is multiplied; the rest of the
mean is taken out exactly at the end, so that the matrix does not depend on how rows are dealt out. The driver holds
matrices of dimension x dimension only. Its eigenvectors: Householder reflections to a tridiagonal matrix, bisection on
Sturm counts for the leading eigenvalues, inverse iteration for their vectors, those of a cluster of close eigenvalues
made orthogonal to each other. The projection (dimension x components) goes to all rows.

Rows whose vector is null, or holds a null or non-finite entry, take no part. Vectors shorter than the longest are read
as if zeros followed; entries beyond 2^40 count as 2^40. Repeated rows are whitened each for itself, and counted once.
Components whose eigenvalue is nothing but rounding (below 1e-12 of the greatest; all, if the vectors do not differ) have
no direction and are left out. Equal eigenvalues: any orthonormal vectors of their space. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._state import discard, materialise

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
_MOST = 1 << 40
_NOISE = 1e-12
_EPS = np.finfo(float).eps


class Whitening(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension
    total: float  # trace of the covariance
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimension x component, unit columns
    identity_error: float


# --- eigenvalues of a symmetric matrix ------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that lead from v to them."""
    a, n = v.astype(float).copy(), len(v)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        u = x.copy()
        u[0] += math.copysign(size, x[0])
        length = np.linalg.norm(u)
        u = u / length if length > 0 else np.zeros_like(u)
        mirrors.append(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues of a tridiagonal matrix, falling: bisection on how many lie below a number."""
    n, off = len(d), np.concatenate([[0.0], e])
    radius = np.abs(off) + np.concatenate([np.abs(e), [0.0]])
    low, high = (d - radius).min(), (d + radius).max()
    size = max(abs(low), abs(high), np.finfo(float).tiny)
    tiny = _EPS * _EPS * size
    square = off * off

    def below(x: np.ndarray) -> np.ndarray:
        count, q = np.zeros(len(x), int), np.ones_like(x)
        for i in range(n):
            q = d[i] - x - square[i] / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            count += q < 0
        return count

    wanted = n - 1 - np.arange(k)  # the eigenvalue with this many before it
    lo, hi = np.full(k, low - 2 * _EPS * size), np.full(k, high + 2 * _EPS * size)
    for _ in range(120):
        mid = (lo + hi) / 2
        right = below(mid) > wanted
        hi, lo = np.where(right, mid, hi), np.where(right, lo, mid)
        if np.all(hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi))):
            break
    return (lo + hi) / 2


def _solver(d: np.ndarray, e: np.ndarray, x: float, tiny: float):
    """LU factors, rows swapped where that is safer, of the tridiagonal matrix less x."""
    n = len(d)
    u, v, w, low, swapped = d - x, np.append(e, 0.0), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        if abs(e[i]) > abs(u[i]):
            swapped[i] = True
            m = u[i] / e[i]
            u[i], next_u, next_v = e[i], v[i] - m * u[i + 1], -m * v[i + 1]
            v[i], w[i] = u[i + 1], v[i + 1]
            u[i + 1], v[i + 1] = next_u, next_v
        else:
            if abs(u[i]) < tiny:
                u[i] = tiny
            m = e[i] / u[i]
            u[i + 1] -= m * v[i]
        low[i] = m
    if abs(u[-1]) < tiny:
        u[-1] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - low[i] * y[i + 1]
            else:
                y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, -1, -1):
            y[i] = (y[i] - (v[i] * y[i + 1] if i + 1 < n else 0.0) - (w[i] * y[i + 2] if i + 2 < n else 0.0)) / u[i]
        return y

    return solve


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of these eigenvalues, as columns, by inverse iteration."""
    n = len(d)
    size = max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(float).tiny)
    out, near = np.zeros((n, len(values))), 1e-3 * size
    start, last = 0, np.inf
    for k, x in enumerate(values):
        if k and values[k - 1] - x > near:
            start = k
        x = min(x, last - 10 * _EPS * size)  # equal values are parted, so that their systems differ
        last = x
        solve = _solver(d, e, x, _EPS * size)
        z = np.random.default_rng(k).uniform(0.5, 1.5, n)
        for _ in range(6):
            z = solve(z / np.linalg.norm(z))
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, start:k] @ (out[:, start:k].T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    n = len(v)
    scale = np.abs(v).max(initial=0)
    if not n or scale == 0:
        return np.zeros(0), np.zeros((n, 0))
    d, e, mirrors = tridiagonal(v / scale)
    values = leading_values(d, e, min(k, n))
    vectors = eigenvectors(d, e, values)
    for j in range(len(mirrors) - 1, -1, -1):
        u = mirrors[j]
        vectors[j + 1 :] -= 2 * np.outer(u, u @ vectors[j + 1 :])
    keep = values > _NOISE * values[0]
    return values[keep] * scale, vectors[:, keep] / np.linalg.norm(vectors[:, keep], axis=0)


# --- sums on Spark --------------------------------------------------------------------------------


def _cells(vector: Column) -> Column:
    """The integer vector, null where the vector takes no part."""
    whole = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    near = lambda c: F.greatest(F.lit(float(-_MOST)), F.least(F.lit(float(_MOST)), c.cast("double") * SCALE))
    return F.when(whole, F.transform(vector, lambda c: F.floor(near(c)) + F.lit(SHIFT)))


def _wide(vector: Column, size: int) -> Column:
    return F.concat(vector, F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(size) - F.size(vector)))


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(len(col), size)


def _fits(rows: int, *most: int) -> bool:
    return rows * math.prod(int(m) + 1 for m in most) < 1 << 62


def _times(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """a' b of integers, exact: in doubles while sums stay below 2^53, then in longs, then in Python's integers."""
    x, y = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    if n * (int(x) + 1) * (int(y) + 1) < 1 << 53:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64)
    return a.T @ b if _fits(n, x, y) else a.T.astype(object) @ b.astype(object)


def _summed(cells: DataFrame, size: int, centre: list[int]) -> tuple[int, list[int], np.ndarray]:
    """Over all vectors less centre: their number, sums, and sums of products; exact at any size."""
    middle = np.array(centre, np.int64)
    upper = np.triu_indices(size + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = _matrix(batch, "x", size) - middle
            y = np.concatenate([np.ones((len(y), 1), np.int64), y], 1)  # products with one are count and sums
            part = _times(y, y, len(y)).astype(object)
            total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(t)) for t in total[upper]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), values], ["cell", "value"])

    parts = cells.mapInArrow(partial, "cell long, value decimal(38,0)")
    found = {r["cell"]: int(r["value"]) for r in parts.groupBy("cell").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}  # (size + 1)(size + 2) / 2 rows
    out = np.zeros((size + 1, size + 1), object)
    out[upper] = [found.get(i, 0) for i in range(len(upper[0]))]
    out = np.where(np.tri(size + 1, k=-1, dtype=bool), out.T, out)
    return int(out[0, 0]), [int(s) for s in out[0, 1:]], out[1:, 1:]


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - S/n) on each component over the root of its eigenvalue; the difference is formed in integers where they fit."""
    shifted = [s - model.n * SHIFT for s in model.sums]
    y = x - SHIFT
    if _fits(1, model.n, np.abs(y).max(initial=0)) and _fits(1, max(map(abs, shifted), default=0)):
        away = (y * model.n - np.array(shifted, np.int64)).astype(float)
    else:
        away = (y.astype(object) * model.n - np.array(shifted, object)).astype(float)
    return away / model.n @ (model.vectors / np.sqrt(model.values))


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum of (n x - S)^2; null where that is no long."""
    y, shifted = x - SHIFT, np.array([s - model.n * SHIFT for s in model.sums], object)
    most = max(np.abs(y).max(initial=0) * model.n, *map(abs, shifted), 0) if x.shape[1] else 0
    if _fits(x.shape[1], 2 * most, 2 * most):
        away = y * model.n - shifted.astype(np.int64)
        return (away * away).sum(1).tolist()
    away = y.astype(object) * model.n - shifted
    return [v if v < 1 << 63 else None for v in map(int, (away * away).sum(1))]


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The table with its integer vectors (`x`; rows that take part alone), and the whitening that was learned from it."""
    rows = embeddings.select("vec_id", _cells(F.col(column)).alias("x")).where("x is not null")
    rows = materialise(rows, "cells")
    size = rows.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0
    if not size:
        return rows, None
    rows = rows.select("vec_id", _wide(F.col("x"), size).alias("x"))
    listed = materialise(rows.select("x").distinct(), "fit")
    first = listed.agg(F.count("*").alias("n"), *(F.sum(F.element_at("x", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size))).first()
    n, sums = first["n"], [int(first[f"s{i}"]) for i in range(size)]
    centre = [round(s / n) for s in sums]
    _, rest, products = _summed(listed, size, centre)
    # n^2 V, in integers; each entry is rounded once
    v = np.array([[float(n * products[i, j] - rest[i] * rest[j]) / n / n for j in range(size)] for i in range(size)])
    values, vectors = leading(v, components)
    model = Whitening(n, sums, float(np.trace(v)), values, vectors, 0.0)
    model = model._replace(identity_error=_identity_error(listed, model, size))
    discard(listed)
    return rows, model


def _identity_error(listed: DataFrame, model: Whitening, size: int) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k + 1)), False
        for batch in batches:
            w, seen = _projected(_matrix(batch, "x", size), model), True
            total += w.T @ np.concatenate([w, np.ones((len(w), 1))], 1)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], ["cell", "value"])

    sums = listed.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # components x (components + 1) rows
    total = np.zeros(k * (k + 1))
    for r in sums:
        total[r["cell"]] = r["value"]
    total = total.reshape(k, k + 1) / model.n
    return float(np.abs(total[:, :k] - np.outer(total[:, k], total[:, k]) - np.eye(k)).max())


REPORT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every vector that takes part as `components` values at most: vec_id, whitened (array of double, of unit covariance over the fit list)."""
    rows, model = fit(embeddings, column, components)
    if model is None:
        return rows.select("vec_id", F.array().cast("array<double>").alias("whitened"))
    size = len(model.sums)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _projected(_matrix(batch, "x", size), model)
            offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))], ["vec_id", "whitened"])

    return rows.mapInArrow(stream, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, whitened array<double>")


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    rows, model = fit(embeddings, "embedding", components)
    schema = REPORT.format(id=rows.schema["vec_id"].dataType.simpleString())
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    size, k = len(model.sums), len(model.values)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", size)
            rows_at = pa.array(np.repeat(np.arange(len(x)), k))
            many = len(x) * k
            columns = [
                batch.column(0).take(rows_at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, model.n, np.int64)),
                pa.array(_deviation(x, model), pa.int64()).take(rows_at), pa.array(_projected(x, model).ravel()), pa.array(np.tile(model.values / model.total, len(x))), pa.array(np.full(many, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(stream, schema)
