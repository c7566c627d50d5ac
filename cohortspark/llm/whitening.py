"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the vectors' covariance V are found without V: a pass over the vectors gives V times a narrow
block, as sums of centred XᵀXQ over the tasks. A polynomial recurrence of such passes keeps what lies below the block's
smallest Ritz value small and lets the rest grow; QR and a Rayleigh-Ritz step turn the block, and its residuals certify
the result: an eigenvalue of V lies within the residual of each Ritz value. The driver holds the block, never vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_resources, table

SCALE, SHIFT, HELD = 1024, 100_000, 1 << 40
#: How far the wanted directions may grow apart in one round; more would cost the weaker ones their digits.
APART = 1e7


@dataclass
class Whitening:
    """n vectors with integer sums S; unit eigenvectors as columns, by falling eigenvalue. residual: the largest norm of
    V q - e q, as a share of the first eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    identity_error: float = math.nan


def integers(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector is not null, has only finite entries and `dims` of them (None: any number), and all entries of those
    rows as floor(SCALE * c) + SHIFT. Entries beyond +-HELD are held there."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = pc.fill_null(column.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(size))
    keep = (size > 0) & (bad == 0) & ((size == dims) if dims is not None else True)
    x = np.clip(np.floor(SCALE * flat[keep[row]]), -HELD, HELD).astype(np.int64) + SHIFT
    return np.flatnonzero(keep), x


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, _ = integers(batch.column(0))
        size = pc.list_value_length(batch.column(0)).take(pa.array(rows))
        dims, n = np.unique(size.to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int64()), pa.array(n, pa.int64())], ["dims", "n"])


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(0), dims)
            total = x.reshape(len(rows), dims).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([total], pa.list_(pa.int64()))], ["n", "s"])

    return run


def _centred(x: np.ndarray, dims: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x less its mean, and x less the mean's whole part, which is exact."""
    whole = x.reshape(-1, dims) - np.array([s // n for s in sums], np.int64)
    return whole - np.array([(s % n) / n for s in sums]), whole


def _added(frame: DataFrame, work, size: int) -> np.ndarray:
    """Sum over all tasks of the array that `work` gives for each batch's centred rows; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += work(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

    parts = frame.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("pos", "x"))
    out = np.zeros(size)
    for r in parts.groupBy("pos").agg(F.sum("x").alias("x")).collect():
        out[r["pos"]] = r["x"]
    return out


def fit(vectors: DataFrame, column: str = "embedding", *, components: int = 8, guard: int = 24, degree: int = 12, tolerance: float = 1e-13, max_rounds: int = 40, seed: int = 0) -> Whitening | None:
    """Leading eigenvectors of the covariance (divisor n) of all vectors, certified by their residuals.

    Vectors that are null, empty or hold null or non-finite entries don't count; of several lengths the most frequent one
    counts (the longer of two as frequent). None without such vectors. Eigenvalues of at most 1e-12 of the trace count as 0
    and have no component: fewer come back, none if all vectors are equal. The rounds end when every wanted residual is
    within `tolerance` of the first eigenvalue, or has stopped falling; `residual` says where."""
    bound_resources(vectors.sparkSession)
    vectors = vectors.select(F.col(column).alias("v"))
    found = vectors.mapInArrow(_sizes, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if found is None:
        return None
    dims = found["dims"]
    sums, n = [0] * dims, found["n"]
    parts = vectors.mapInArrow(_sums(dims), "n long, s array<long>").select(F.posexplode("s").alias("pos", "s"))
    for r in parts.groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["pos"]] = int(r["s"])

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q, and the trace of V."""

        def work(column: pa.Array) -> np.ndarray:
            c, _ = _centred(integers(column, dims)[1], dims, n, sums)
            return np.append(c.T @ (c @ q), (c * c).sum())

        out = _added(vectors, work, q.size + 1) / n
        return out[:-1].reshape(q.shape), float(out[-1])

    wanted = min(components, dims)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, min(dims, components + guard))))
    best, behind = math.inf, 0
    for turn in range(max_rounds):
        y, trace = times(q)
        values, turned = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, y = q @ turned, y @ turned
        if values[0] <= 0:
            return Whitening(n, sums, q[:, :0], values[:0], max(trace, 0.0), 0.0)
        residual = float(np.linalg.norm(y - q * values, axis=0)[:wanted].max() / values[0])
        behind = 0 if residual < best / 2 else behind + 1
        best = min(best, residual)
        if residual <= tolerance or behind >= 3 or q.shape[1] == dims:
            break
        q = _filtered(q, values, wanted, degree, times)
    rank = int((values[:wanted] > 1e-12 * trace).sum())
    model = Whitening(n, sums, q[:, :rank], values[:rank].copy(), trace, residual)
    model.identity_error = _identity_error(vectors, model)
    return model


def _filtered(q: np.ndarray, values: np.ndarray, wanted: int, degree: int, times) -> np.ndarray:
    """The block after a scaled Chebyshev polynomial of V that is at most 1 between 0 and the smallest Ritz value."""
    top, low = values[0], max(values[-1], 1e-14 * values[0])
    half = low / 2
    grows = lambda value: math.acosh(max(1.0, value / half - 1))
    gap = grows(top) - grows(values[wanted - 1])
    degree = max(1, min(degree, int(math.log(APART) / gap) if gap > 0 else degree))
    first = half / (top - half) if top > half else 1.0
    rate, before, now = first, q, (times(q)[0] - half * q) * (first / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - rate)
        before, now, rate = now, (times(now)[0] - half * now) * (2 * after / half) - before * (rate * after), after
    return np.linalg.qr(now)[0]


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, by one more pass."""
    k, dims = len(model.values), len(model.sums)
    if not k:
        return 0.0
    turn = model.vectors / np.sqrt(model.values)

    def work(column: pa.Array) -> np.ndarray:
        w = _centred(integers(column, dims)[1], dims, model.n, model.sums)[0] @ turn
        return np.append(w.T @ w, w.sum(0))

    out = _added(vectors, work, k * k + k) / model.n
    mean = out[k * k :]
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, residual): a row for each counted vector and
    component. deviation is exact; null where it doesn't fit a long. Ids may be null or repeat: each row is its own.
    Without components there are no rows."""
    frame = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("v"))
    kind = frame.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if model is None or not len(model.values):
        return frame.sparkSession.createDataFrame([], schema)
    n, sums, dims, k = model.n, model.sums, len(model.sums), len(model.values)
    turn = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace
    left = np.array([s % n for s in sums], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column("v"), dims)
            centred, whole = _centred(x, dims, n, sums)
            size = ((n * centred) ** 2).sum(1)
            fits = size < 2.0**62
            apart = np.zeros(len(rows), np.int64)
            apart[fits] = ((n * whole[fits] - left) ** 2).sum(1)
            deviation = apart.tolist()
            for i in np.flatnonzero(~fits):
                exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(whole[i], left, strict=True))
                deviation[i] = exact if exact < 1 << 63 else None
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), n)),
                pa.array(deviation, pa.int64()).take(each), pa.array((centred @ turn).ravel()), pa.array(np.tile(explained, len(rows))),
                pa.array(np.full(len(each), model.identity_error)), pa.array(np.full(len(each), model.residual)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return frame.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors))
