"""Means and covariances of many columns at once, as packed matrices.

With F columns a covariance matrix has F (F + 1) / 2 entries; an aggregate column for each leaves generated code at some
thirty features. Here a map task sends one row for each key it holds: the key's mean and centred outer products as arrays, or its
rows as they are where that is smaller. The reducer adds them up. One shuffle, by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpacked(scatter: np.ndarray, f: int) -> np.ndarray:
    """Symmetric f x f matrices from rows of their upper triangles."""
    out = np.empty((len(scatter), f, f))
    i, j = np.triu_indices(f)
    out[:, i, j] = out[:, j, i] = scatter
    return out


def merged(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred outer products of several parts together."""
    total = n.sum()
    middle = (n[:, None] * mean).sum(0) / total
    apart = mean - middle
    return int(total), middle, scatter.sum(0) + np.einsum("p,pi,pj->ij", n, apart, apart)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def moments(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, mean, scatter): for each key the number of rows, the columns' means, and the sums of centred products as
    the upper triangle of a matrix, row by row. Rows with a null in a column are left out; NaN makes a column's entries NaN."""
    f = len(columns)
    wide = frame.select(*keys, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    kinds = ", ".join(f"`{k}` {wide.schema[k].dataType.simpleString()}" for k in keys)
    upper = np.triu_indices(f)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # nulls are looked for here: as many not-null filters over renamed columns would occupy the optimizer
            batch = batch.filter(pa.array(~np.any([batch.column(f"_{i}").is_null().to_numpy(zero_copy_only=False) for i in range(f)], axis=0)))
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(f)], 1)
            changed = np.zeros(batch.num_rows, bool)
            changed[0] = True
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                changed[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(changed)
            n, means, products, rows = [], [], [], []
            for a, b in zip(first, np.append(first[1:], len(x)), strict=True):
                part, many = x[a:b], 2 * (b - a) > f
                mean = part.mean(0) if many else None
                n.append(b - a)
                means.append(mean)
                products.append(((part - mean).T @ (part - mean))[upper] if many else None)
                rows.append(None if many else part.ravel())
            out = [batch.column(k).take(pa.array(first)) for k in keys]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), _lists(means), _lists(products), _lists(rows)], [*keys, "n", "mean", "scatter", "rows"])

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy().astype(float)
        sums = [i for i, m in enumerate(table.column("mean").to_pylist()) if m is not None]
        mean = np.array([m for m in table.column("mean").to_pylist() if m is not None]).reshape(-1, f)
        scatter = unpacked(np.array([s for s in table.column("scatter").to_pylist() if s is not None]).reshape(-1, f * (f + 1) // 2), f)
        rows = np.array(table.column("rows").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, f)
        n = n[sums]
        if len(rows):
            middle = rows.mean(0)
            n, mean = np.append(n, len(rows)), np.vstack([mean, middle])
            scatter = np.concatenate([scatter, ((rows - middle).T @ (rows - middle))[None]])
        total, middle, products = merged(n, mean, scatter)
        head = [table.column(k).slice(0, 1) for k in keys]
        return pa.table([*head, pa.array([total], pa.int64()), _lists([middle]), _lists([products[upper]])], names=[*keys, "n", "mean", "scatter"])

    sent = wide.sortWithinPartitions(*keys).mapInArrow(parts, f"{kinds}, n long, mean array<double>, scatter array<double>, rows array<double>")
    return sent.groupBy(*keys).applyInArrow(add, f"{kinds}, n long, mean array<double>, scatter array<double>")
