"""Distances along a surface, up to a bound.

Whatever lies within a bound along the surface lies within it in space. So a surface is cut into cubes, each with a rim as
wide as the bound: every short path from a cube's own vertices stays inside, and cubes are worked on independently
after one shuffle. Inside a cube, paths from many vertices grow at once, in steps of about an edge's length, and stop at the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a cube in bounds; vertices whose paths grow at once.
CUBE, AT_ONCE = 4, 256


def distances(points: DataFrame, edge: DataFrame, surface: list[str], reach: float) -> DataFrame:
    """(surface, a, b, distance): every pair of vertices whose shortest path along edges is at most `reach` long, and each
    vertex with itself at 0. points are (surface, vertex, x, y, z), edge (surface, a, b) in both directions.

    Vertices without finite coordinates have only themselves. The result has a row for each vertex and neighbour within the
    bound, so the bound sets its size."""
    side = CUBE * reach
    finite = F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    at = lambda n: points.where(finite).select(*surface, F.col("vertex").alias(n), *[F.col(c).cast("double").alias(f"{c}_{n}") for c in "xyz"])
    long = F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in "xyz"), F.lit(0.0)))
    sides = edge.join(at("a").hint("merge"), [*surface, "a"]).join(at("b").hint("merge"), [*surface, "b"]).withColumn("length", long).where((F.col("length") <= reach) & (F.col("a") != F.col("b")))
    own = F.lit(True)
    for i, c in enumerate("xyz"):
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        cubes = F.sequence(F.floor((F.greatest(a, b) - reach) / side), F.floor((F.least(a, b) + reach) / side))
        sides = sides.withColumn(f"c{i}", F.explode(F.when(F.floor((F.greatest(a, b) - reach) / side) <= F.floor((F.least(a, b) + reach) / side), cubes)))
        own = own & (F.floor(a / side) == F.col(f"c{i}"))
    cube = [*surface, "c0", "c1", "c2"]
    kinds = dict(points.select(*surface, F.col("vertex").alias("a")).dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in surface], f"a {kinds['a']}, b {kinds['a']}, distance double"])

    def grow(table: pa.Table) -> pa.Table:
        names, place = np.unique(np.concatenate([table.column("a").to_numpy(), table.column("b").to_numpy()]), return_inverse=True)
        a, b = place[: table.num_rows], place[table.num_rows :]
        found = _within(a, b, table.column("length").to_numpy(), np.unique(a[table.column("own").to_numpy()]), len(names), reach)
        fixed = [table.column(c).take(pa.array(np.zeros(len(found[0]), np.int64))) for c in surface]
        return pa.table([*fixed, pa.array(names[found[0]]), pa.array(names[found[1]]), pa.array(found[2])], names=[*surface, "a", "b", "distance"])

    pairs = sides.select(*cube, "a", "b", "length", own.alias("own")).groupBy(*cube).applyInArrow(grow, schema)
    self = points.select(*surface, F.col("vertex").alias("a"), F.col("vertex").alias("b"), F.lit(0.0).alias("distance")).repartition(*surface, "a").distinct()
    return pairs.unionByName(self)


def _within(a: np.ndarray, b: np.ndarray, length: np.ndarray, starts: np.ndarray, n: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, other, distance) for all others within reach, by delta-stepping from AT_ONCE starts at a time."""
    order = np.argsort(a, kind="stable")
    b, length, first = b[order], length[order], np.searchsorted(a[order], np.arange(n + 1))
    delta = float(np.median(length)) if len(length) else 1.0
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for some in np.array_split(starts, 1 + len(starts) // AT_ONCE):
        best = np.full((len(some), n), np.inf)
        best[np.arange(len(some)), some] = 0.0
        row, node = np.arange(len(some)), some
        while len(row):
            far = best[row, node]
            near = far <= far.min() + delta
            waiting = (row[~near], node[~near])
            row, node, far = row[near], node[near], far[near]
            per = first[node + 1] - first[node]
            edge = np.repeat(first[node] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            to, further, row = b[edge], np.repeat(far, per) + length[edge], np.repeat(row, per)
            better = (further <= reach) & (further < best[row, to])
            row, to, further = row[better], to[better], further[better]
            np.minimum.at(best, (row, to), further)
            key = np.unique(np.concatenate([row * n + to, waiting[0] * n + waiting[1]]))
            row, node = key // n, key % n
        row, other = np.nonzero(np.isfinite(best) & (best > 0))
        parts.append((some[row], other, best[row, other]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def kernel(points: DataFrame, edge: DataFrame, surface: list[str], sigma: float, reach: float | None = None) -> DataFrame:
    """(surface, a, b, w): weights exp(-d^2 / (2 sigma^2)) of the distance along the surface, up to `reach` (3 sigma)."""
    near = distances(points, edge, surface, 3 * sigma if reach is None else reach)
    return near.select(*surface, "a", "b", F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma)).alias("w"))
