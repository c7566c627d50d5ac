"""Nearest neighbours over adaptive cells.

A k-d tree is cut from a sample of the sources, so cells are small where sources are dense. The sample points of a
target's own cell bound its distance before anything is joined; only cells whose box is within that bound are probed, by an
equality join on the cell. Cells that many targets probe are dealt out in blocks. There are no rounds: one scan for each of the
tree, the boxes and the counts, whose sizes are those of the tree, and one join.
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

#: Sources in a cell, sample points in a cell, targets in a block; levels of the tree at most, which bounds what tasks are sent.
PER_CELL, PER_SAMPLE, BLOCK, DEPTH = 1024, 16, 4096, 14
PLACED = "coalesce(abs(x) < double('infinity') and abs(y) < double('infinity') and abs(z) < double('infinity'), false)"


@dataclass
class Tree:
    """A complete binary tree in heap order: node m has children 2m and 2m + 1, the leaves are cells."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray  # boxes of the nodes' sources; empty ones are infinitely far
    high: np.ndarray
    sample: np.ndarray  # by cell
    bounds: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.axis)

    def cell(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        while len(at) and at[0] < self.cells:
            at = 2 * at + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at - self.cells

    def away(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance of each point to a node's box."""
        gap = np.maximum(0, np.maximum(self.low[node] - x, x - self.high[node]))
        return (gap * gap).sum(1)

    def reach(self, x: np.ndarray) -> np.ndarray:
        """A squared distance within which each point surely has a source: to the sample points of its cell, and to the far
        corner of the nearest box found on the way down."""
        near, at = np.full(len(x), np.inf), np.ones(len(x), np.int64)
        while len(at):
            far = np.maximum(np.abs(x - self.low[at]), np.abs(x - self.high[at]))
            near = np.minimum(near, (far * far).sum(1))
            if at[0] >= self.cells:
                break
            at = 2 * at + (self.away(x, 2 * at) > self.away(x, 2 * at + 1))
        for cell in (at - self.cells, self.cell(x)):
            order = np.argsort(cell, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                mine = self.sample[self.bounds[cell[rows[0]]] : self.bounds[cell[rows[0]] + 1]]
                for some in np.array_split(rows, 1 + len(rows) // 4096) if len(mine) else []:
                    near[some] = np.minimum(near[some], _squares(x[some], mine).min(1))
        return near

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for every cell that may hold a point's nearest source, found level by level."""
        within = self.reach(x) * (1 + 1e-9)
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        while len(node) and node[0] < self.cells:
            row, node = np.repeat(row, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
            keep = self.away(x[row], node) <= within[row]
            row, node = row[keep], node[keep]
        return row, node - self.cells


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = [x[:, None, c] - y[None, :, c] for c in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _xyz(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)


def plant(sources: DataFrame, n: int, per_cell: int = PER_CELL) -> Tree:
    """The tree of n sources: splits at the medians of a sample of about PER_SAMPLE points a cell, along each node's widest
    axis; boxes from all sources."""
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / per_cell))))
    cells = 1 << depth
    share = PER_SAMPLE * cells / max(1, n)
    few = sources.select("x", "y", "z").where(F.shiftrightunsigned(F.xxhash64("x", "y", "z"), 11) / float(1 << 53) < share) if share < 1 else sources.select("x", "y", "z")
    sample = np.array([(r["x"], r["y"], r["z"]) for r in few.distinct().collect()]).reshape(-1, 3)
    axis, cut, of = np.zeros(cells, np.int64), np.zeros(cells), np.ones(len(sample), np.int64)
    for _ in range(depth):
        for node in np.unique(of):
            mine = sample[of == node]
            axis[node] = np.argmax(mine.max(0) - mine.min(0))
            cut[node] = np.median(mine[:, axis[node]])
        of = 2 * of + (sample[np.arange(len(of)), axis[of]] > cut[of])
    tree = Tree(axis, cut, np.full((2 * cells, 3), np.inf), np.full((2 * cells, 3), np.inf), sample, np.zeros(cells + 1, np.int64))
    ends = [f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("low", F.min), ("high", F.max))]
    for r in in_cells(sources.select("x", "y", "z"), tree).groupBy("cell").agg(*ends).collect():  # at most `cells` rows
        tree.low[cells + r["cell"]], tree.high[cells + r["cell"]] = [r[f"low_{c}"] for c in "xyz"], [r[f"high_{c}"] for c in "xyz"]
    for node in range(cells - 1, 0, -1):
        a, b = tree.low[2 * node : 2 * node + 2], tree.high[2 * node : 2 * node + 2]
        tree.low[node] = a.min(0)
        tree.high[node] = np.where(np.isinf(b), -np.inf, b).max(0) if not np.isinf(b).all() else np.inf
    cell = tree.cell(sample)
    tree.sample, tree.bounds = sample[np.argsort(cell, kind="stable")], np.searchsorted(np.sort(cell), np.arange(cells + 1))
    return tree


def _schema(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def in_cells(points: DataFrame, tree: Tree, blocks: np.ndarray | None = None) -> DataFrame:
    """Points with their cell; with blocks, once for each of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.cell(_xyz(batch))
            each = np.ones(len(cell), np.int64) if blocks is None else blocks[cell]
            row = np.repeat(np.arange(len(cell)), each)
            block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns], pa.array(cell[row]), pa.array(block)], [*batch.schema.names, "cell", "block"])

    return points.mapInArrow(run, f"{_schema(points)}, cell long, block long")


def probing(points: DataFrame, tree: Tree, blocks: np.ndarray | None = None) -> DataFrame:
    """Points with every cell to probe, a row for each, and one of the cell's blocks by the point's hash h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = tree.probes(_xyz(batch))
            block = np.zeros(len(row), np.int64) if blocks is None else batch.column("h").to_numpy()[row] % blocks[cell]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns], pa.array(cell), pa.array(block)], [*batch.schema.names, "cell", "block"])

    return points.mapInArrow(run, f"{_schema(points)}, cell long, block long")


def nearest_resample(targets: DataFrame, sources: DataFrame, per_cell: int = PER_CELL) -> DataFrame:
    """(target, source, value, d2): every target's nearest source, the smallest id where several are as near.

    Exact, however sources are clustered and however far targets are. Points with a null or non-finite coordinate are near
    nothing; without sources there are no rows. Sources in one place are one candidate, so no cell is larger than the sample's
    medians allow; a cell's targets are dealt out in blocks of about BLOCK."""
    typed = [F.col(c).cast("double").alias(c) for c in "xyz"]
    targets, sources = targets.where(PLACED).select("target", *typed, F.xxhash64("target").alias("h")), sources.where(PLACED).select("source", *typed, "value")
    kinds = f"target {targets.schema['target'].dataType.simpleString()}, source {sources.schema['source'].dataType.simpleString()}, value {sources.schema['value'].dataType.simpleString()}, d2 double"
    n = sources.count()
    if not n:
        return targets.sparkSession.createDataFrame([], kinds)
    tree = plant(sources, n, per_cell)
    blocks = np.ones(tree.cells, np.int64)
    for r in probing(targets, tree).groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most `cells` rows
        blocks[r["cell"]] = -(-r["n"] // BLOCK)
    places = sources.groupBy("x", "y", "z").agg(F.min(F.struct("source", "value")).alias("s")).select("x", "y", "z", "s.source", "s.value")
    left, right = probing(targets, tree, blocks), in_cells(places, tree, blocks)

    def best(here: pa.Table, there: pa.Table) -> pa.Table:
        there = there.take(pc.sort_indices(there.column("source")))  # the first of equals is the smallest id
        x, y = _xyz(here), _xyz(there)
        pick, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
        for some in np.array_split(np.arange(len(x)), 1 + len(x) * len(y) // (1 << 20)) if len(y) else []:
            d = _squares(x[some], y)
            pick[some] = d.argmin(1)
            d2[some] = d[np.arange(len(some)), pick[some]]
        if not len(y):
            here = here.slice(0, 0)
            pick, d2 = pick[:0], d2[:0]
        chosen = there.take(pa.array(pick))
        return pa.table([here.column("target"), chosen.column("source"), chosen.column("value"), pa.array(d2)], names=["target", "source", "value", "d2"])

    found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(best, kinds)
    return found.groupBy("target").agg(F.min(F.struct("d2", "source", "value")).alias("m")).select("target", "m.source", "m.value", "m.d2")
