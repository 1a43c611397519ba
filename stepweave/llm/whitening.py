"""Whitening of vectors by Chebyshev-filtered subspace iteration.

Entries become whole numbers ``floor(scale * c) + shift``. With ``n`` vectors
and per-dimension sums ``S``, all centred entries are ``(n * x - S) / n``, the
numerator exact. The leading eigenvectors of the covariance ``V`` are found
without ever forming ``V``: a pass over the vectors multiplies a block of
columns ``Q`` by ``V`` (each task adds up ``C'(C Q)`` over its rows, Spark adds
up the tasks), so a task, the driver and the broadcast block hold
``dimensions x block`` numbers however many vectors there are.

1. A few Lanczos steps bound the spectrum from below.
2. A Chebyshev polynomial of ``V``, by its three-term recurrence, damps the
   spectrum between that bound and the block's least Ritz value. Its degree is
   such that the leading direction does not drown the others; pairs that are
   certified are locked and projected out of the recurrence.
3. QR and Rayleigh-Ritz give the next block and its residuals.
4. Iteration ends when the residual ``|Vq - eq|`` of every wanted pair is at
   rounding level, or no longer falls and is certified to ``CERTIFIED``. Each
   eigenvalue is within its residual of a true one.

A last pass takes the covariance of the whitened vectors.

Cases: null and empty vectors, and vectors with a null or non-finite entry, take
no part; nor do vectors of another length than most (the longer of two equally
frequent lengths stays). Entries are limited to ``LIMIT`` (2^53) in size.
Repeated rows and equal ids are vectors of their own, a null id stays. There are
as many components as the covariance has directions of positive variance, 32 at
most; so a single vector, equal vectors and an empty table give no rows. A
deviation beyond a 64-bit number is set to the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepweave.llm.common import ship
from stepweave.session import cut_lineage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LIMIT = 2**53
LANCZOS_STEPS = 10
DEGREE = 10
GROWTH = 1e10  # of the leading direction against the last wanted one
ROUNDING = 1e-14  # residuals against the largest eigenvalue
CERTIFIED = 1e-10
MAX_ROUNDS = 200
NO_VARIANCE = 1e-13
ROWS_AT_ONCE = 4_096
LARGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, vector: str, id_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id, x``: the vectors that take part, as whole numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def limited(c):
        return F.least(F.greatest(c * scale, F.lit(float(shift - LIMIT))), F.lit(float(LIMIT - shift)))

    rows = cut_lineage(
        vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
        .select("id", F.transform("v", lambda c: F.floor(limited(c)) + shift).alias("x"))
    )
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (length["length"] if length else 0))


@dataclass
class Centre:
    """Number of vectors and sums per dimension; what a task needs to centre exactly."""

    n: int
    sums: list[int]
    largest: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, in Python's integers where 64 bits may not do."""
        if self.n * self.largest < 2**61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.scaled(x)
        if y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * y.shape[1] > LARGEST:
            y = y.astype(object)
        return [min(LARGEST, int(s)) for s in (y * y).sum(1)]


def centre_of(rows: DataFrame) -> Centre:
    entries = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at")
    found = entries.agg(
        F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max(F.abs("c")).alias("most")
    ).collect()
    found.sort(key=lambda r: r["at"])
    if not found:
        return Centre(0, [], 0)
    return Centre(found[0]["n"], [int(r["s"]) for r in found], max(r["most"] for r in found))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, dims)


def _sum_over_rows(rows: DataFrame, dims: int, of_rows, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices ``of_rows(x)`` over all blocks of rows: added up per task, then by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, dims):
            total += of_rows(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    found = rows.select("x").mapInArrow(add, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for r in found.collect():
        out.flat[r["at"]] = r["value"]
    return out


class Covariance:
    """The covariance as an operator: each product is one pass over the vectors."""

    def __init__(self, rows: DataFrame, centre: Centre):
        self.rows, self.centre, self.dims = rows, centre, len(centre.sums)
        self.passes = 0

    def times(self, q: np.ndarray) -> np.ndarray:
        centre = self.centre

        def product(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ q)

        self.passes += 1
        return _sum_over_rows(self.rows, self.dims, product, q.shape) / centre.n

    def trace(self) -> float:
        centre = self.centre
        return float(
            _sum_over_rows(self.rows, self.dims, lambda x: (centre.centred(x) ** 2).sum(keepdims=True), (1, 1))[0, 0]
            / centre.n
        )


def least_eigenvalue(times, dims: int, rng: np.random.Generator, steps: int = LANCZOS_STEPS) -> float:
    """An estimate from below: the least Ritz value of a Lanczos run, less its residual."""
    v = rng.standard_normal(dims)
    basis, diagonal, beside = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, dims)):
        w = times(basis[-1][:, None])[:, 0]
        diagonal.append(float(w @ basis[-1]))
        for _ in range(2):
            for u in basis:
                w = w - (w @ u) * u
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(abs(diagonal[0]), 1e-300):
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(values[0] - abs(beside[-1] * vectors[-1, 0])))


def chebyshev(times, q, vq, low: float, high: float, top: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """``p(V) q`` for the Chebyshev polynomial of ``[low, high]``, scaled to about 1 at ``top``."""
    middle, half = (low + high) / 2, (high - low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        now = now - locked @ (locked.T @ now)
        following = 1 / (2 / first - sigma)
        after = (times(now) - middle * now) * (2 * following / half) - sigma * following * before
        before, now, sigma = now, after, following
    return now


def leading(times, dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues, their unit eigenvectors, and the largest residual."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dims)
    block = min(dims, wanted + max(4, wanted // 2))
    low = least_eigenvalue(times, dims, rng) if block < dims else 0.0
    q = np.linalg.qr(rng.standard_normal((dims, block)))[0]
    vq = times(q)
    best: list[float] = []
    for _ in range(MAX_ROUNDS):
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = float(residuals.max())
        floor = ROUNDING * max(values[0], 0.0)
        best.append(worst)
        stalled = len(best) > 4 and worst <= CERTIFIED * values[0] and min(best[-2:]) > min(best[:-2]) / 2
        if block == dims or worst <= floor or stalled:
            return values[:wanted], q[:, :wanted], worst
        done = int(np.argmax(residuals > floor))
        high, top = float(values[-1]), float(values[done])
        start = min(low, high * (1 - 1e-6))
        half = max((high - start) / 2, 1e-300)
        reach = [np.arccosh(max(1.0, (v - (high + start) / 2) / half)) for v in (top, float(values[wanted - 1]))]
        degree = int(min(DEGREE, max(2, np.log(GROWTH) // max(reach[0] - reach[1], 1e-9))))
        locked, active = q[:, :done], q[:, done:]
        if top <= high:  # all equal: nothing to tell apart
            return values[:wanted], q[:, :wanted], worst
        raised = chebyshev(times, active, vq[:, done:], start, high, top, degree, locked)
        for _ in range(2):
            raised = raised - locked @ (locked.T @ raised)
            raised = np.linalg.qr(raised)[0]
        q, vq = np.hstack([locked, raised]), np.hstack([vq[:, :done], times(raised)])
    raise RuntimeError(f"residual {best[-1]} after {MAX_ROUNDS} rounds")


@dataclass
class Whitening:
    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    trace: float
    residual: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.centred(x) @ self.axes) / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of ``rows`` (``x``), by falling eigenvalue, those of positive variance."""
    centre = centre_of(rows)
    dims = len(centre.sums)
    if centre.n < 2:
        return Whitening(centre, np.empty(0), np.empty((dims, 0)), 0.0, 0.0)
    covariance = Covariance(rows, centre)
    trace = covariance.trace()
    if trace == 0:
        return Whitening(centre, np.empty(0), np.empty((dims, 0)), 0.0, 0.0)
    values, axes, residual = leading(covariance.times, dims, min(components, dims))
    held = values > NO_VARIANCE * trace
    model = Whitening(centre, values[held], axes[:, held], trace, residual)
    k = int(held.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.apply(x)
        return np.vstack([w.T @ w, w.sum(0)])

    found = _sum_over_rows(rows, dims, moments, (k + 1, k)) / centre.n
    model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max()) if k else 0.0
    return model


def whiten(
    vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per vector and component."""
    ship(vectors.sparkSession)
    rows = whole_vectors(vectors, vector, id_col)
    model = fit(rows, components)
    n, k, dims = model.centre.n, len(model.values), len(model.centre.sums)
    explained = model.values / model.trace if k else np.empty(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dims):
            whitened = model.apply(x)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(np.array(model.centre.deviations(x), np.int64), k)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                schema.names,
            )

    schema = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(project, schema)


def digest(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return whitened.withColumnRenamed("id", id_col)
