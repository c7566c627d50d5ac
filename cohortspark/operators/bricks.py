"""Volumes packed as bricks: arrays of 8 x 8 x 8 voxels with a halo of one voxel around them.

A voxel goes to its brick and to the halos of the bricks beside it, about twice in all. Then whatever looks one voxel
around meets all it needs in one row: a point joins one brick by equality instead of eight voxels, and box sums never leave
their brick. Bricks are a table like any other: pack once, sample many point sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
BRICK = ("bi", "bj", "bk")
BITS = 3
SIDE, WIDE = 1 << BITS, (1 << BITS) + 2
CELLS = WIDE**3
_AT_ONCE = 512


def pack(values: DataFrame, volume: list[str]) -> DataFrame:
    """(volume, bi, bj, bk, cells): a brick for every eight-cube that a voxel or its halo falls in; cells is an array of WIDE^3
    doubles in the order i, j, k from the halo's first corner on, null where there is no voxel. A null value is no voxel.

    One shuffle by volume and brick; a group has at most WIDE^3 voxels, so no key is hot."""
    long = values.select(*volume, *[F.col(a).cast("long").alias(a) for a in AXES], F.col("value").cast("double").alias("value")).where("value is not null")
    for a, b in zip(AXES, BRICK, strict=True):
        brick, within = F.shiftright(a, BITS), F.col(a).bitwiseAND(F.lit(SIDE - 1)).cast("int")
        slot = lambda at, place: F.struct(at.alias("b"), place.cast("int").alias("p"))
        slots = F.array_compact(F.array(slot(brick, within + 1), F.when(within == 0, slot(brick - 1, F.lit(WIDE - 1))), F.when(within == SIDE - 1, slot(brick + 1, F.lit(0)))))
        long = long.withColumn("s", F.explode(slots)).withColumns({b: F.col("s.b"), f"p{a}": F.col("s.p")}).drop("s", a)
    place = ((F.col("pi") * WIDE + F.col("pj")) * WIDE + F.col("pk")).alias("place")
    lists = long.groupBy(*volume, *BRICK).agg(F.collect_list(F.struct(place, "value")).alias("e"))
    lists = lists.select(*volume, *BRICK, F.transform("e", lambda x: x["place"]).alias("places"), F.transform("e", lambda x: x["value"]).alias("cells"))
    keys = [*volume, *BRICK]
    schema = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in keys)
    return lists.mapInArrow(_scatter, f"{schema}, cells array<double>")


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _AT_ONCE):
            batch = whole.slice(at, _AT_ONCE)
            lists = batch.column("places")
            n = np.diff(lists.offsets.to_numpy())
            cell = np.repeat(np.arange(batch.num_rows), n) * CELLS + lists.flatten().to_numpy(zero_copy_only=False)
            flat, none = np.zeros(batch.num_rows * CELLS), np.ones(batch.num_rows * CELLS, bool)
            flat[cell], none[cell] = batch.column("cells").flatten().to_numpy(zero_copy_only=False), False
            cells = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * CELLS, pa.array(flat, mask=none))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], cells], [*batch.schema.names[:-2], "cells"])


def _beside(points: DataFrame, bricks: DataFrame, volume: list[str]) -> DataFrame:
    """Each point (with its voxel i, j, k) with its brick's cells, by one equality join; null cells where no brick is. Bricks
    are never broadcast: they are far larger than Spark's estimate of them."""
    placed = points.withColumns({b: F.shiftright(a, BITS) for a, b in zip(AXES, BRICK, strict=True)})
    return placed.join(bricks.select(*volume, *BRICK, "cells").hint("merge"), [*volume, *BRICK], "left")


def _cell(di: int = 0, dj: int = 0, dk: int = 0) -> Column:
    """The value of the voxel so far from a point's own in its brick, null where there is none."""
    place = F.lit(0)
    for a, d in zip(AXES, (di, dj, dk), strict=True):
        place = place * WIDE + F.col(a).bitwiseAND(F.lit(SIDE - 1)).cast("int") + 1 + d
    return F.get("cells", place)


def trilinear(points: DataFrame, bricks: DataFrame, keys: list[str], volume: list[str]) -> DataFrame:
    """(keys, value): bricks interpolated at points x, y, z in voxel units; voxels that aren't there count as 0, a NaN voxel
    gives NaN. A row for each point."""
    low = [F.floor(c).cast("long").alias(a) for a, c in zip(AXES, "xyz", strict=True)]
    part = [(F.col(c) - F.floor(c)).alias(f"f{c}") for c in "xyz"]
    near = _beside(points.select(*keys, *low, *part), bricks, volume)
    total = F.lit(0.0)
    for at in np.ndindex(2, 2, 2):
        weight = F.lit(1.0)
        for c, d in zip("xyz", at, strict=True):
            weight = weight * (F.col(f"f{c}") if d else 1 - F.col(f"f{c}"))
        total = total + weight * F.coalesce(_cell(*at), F.lit(0.0))
    return near.select(*keys, total.alias("value"))


def enclosing(points: DataFrame, bricks: DataFrame, keys: list[str], volume: list[str]) -> DataFrame:
    """(keys, value): the value of the voxel whose centre is nearest to each point x, y, z; null where none is."""
    at = [F.floor(F.col(c) + 0.5).cast("long").alias(a) for a, c in zip(AXES, "xyz", strict=True)]
    return _beside(points.select(*keys, *at), bricks, volume).select(*keys, _cell().alias("value"))


def box_mean(values: DataFrame, volume: list[str]) -> DataFrame:
    """(volume, i, j, k, value) at every voxel: the mean over its 3 x 3 x 3 box.

    A volume without NaN is padded with zeros: its sums are always over 27. In a volume with NaN the mean is over the
    box's voxels that are there and not NaN, NaN without any. Null values count as NaN. Sums run along one axis after the
    other inside each brick."""
    value = F.coalesce(F.col("value").cast("double"), F.lit(float("nan")))
    values = values.select(*volume, *AXES, value.alias("value"))
    holes = values.groupBy(*volume).agg(F.max(F.isnan("value")).alias("holes"))
    bricks = pack(values, volume)
    marked = bricks.join(holes, volume) if volume else bricks.crossJoin(F.broadcast(holes))  # without volume keys: one row
    keys = [*volume, *BRICK]
    schema = ", ".join(f"`{c}` {marked.schema[c].dataType.simpleString()}" for c in volume)
    marked = marked.select(*keys, "holes", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(at, _AT_ONCE)
                cells = batch.column("cells").flatten()
                there = cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, WIDE, WIDE, WIDE)
                x = cells.to_numpy(zero_copy_only=False).reshape(there.shape)
                has = there & ~np.isnan(x)
                total, n = _box(np.where(has, x, 0.0)), _box(has.astype(np.float64))
                holes = batch.column("holes").to_numpy(zero_copy_only=False)[:, None, None, None]
                with np.errstate(invalid="ignore"):
                    mean = np.where(holes, total / np.where(n > 0, n, np.nan), total / 27)
                own = there[:, 1:-1, 1:-1, 1:-1]
                row, *place = np.nonzero(own)
                bricks = [batch.column(b).to_numpy(zero_copy_only=False)[row] for b in BRICK]
                rows = pa.array(row)
                out = [batch.column(c).take(rows) for c in volume] + [pa.array(b * SIDE + p) for b, p in zip(bricks, place, strict=True)] + [pa.array(mean[own])]
                yield pa.RecordBatch.from_arrays(out, [*volume, *AXES, "value"])

    return marked.mapInArrow(run, f"{schema}{', ' if volume else ''}i long, j long, k long, value double")


def _box(x: np.ndarray) -> np.ndarray:
    for axis in (1, 2, 3):
        part = lambda a, b, axis=axis: x[tuple([slice(None)] * axis + [slice(a, b)])]
        x = part(0, -2) + part(1, -1) + part(2, None)
    return x
