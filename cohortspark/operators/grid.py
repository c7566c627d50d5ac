"""Operators on sparse voxel tables (volume keys, i, j, k, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortspark.functions.scores import no_nan
from cohortspark.operators import bricks
from cohortspark.operators.bricks import box_mean as box_mean  # a grid operator like the others

AXES = ("i", "j", "k")


def region_mean(values: DataFrame, labels: DataFrame, regions: DataFrame, volume: list[str]) -> DataFrame:
    """Mean of each region's voxels, NaN skipped; NaN for regions without any. regions has label and region."""
    means = values.join(labels, [*volume, *AXES]).groupBy(*volume, "label").agg(F.avg(no_nan(F.col("value"))).alias("value"))
    every = values.select(*volume).distinct().crossJoin(F.broadcast(regions)) if volume else regions  # regions: 14 in the standard layout
    return every.join(means, [*volume, "label"], "left").select(*volume, "region", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def trilinear(points: DataFrame, values: DataFrame, keys: list[str], volume: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, value): values interpolated at points x, y, z in voxel units; voxels that aren't there count as 0. The volumes are
    packed in bricks, and each point joins one of them, within its volume if there are several (volume is part of keys)."""
    return bricks.trilinear(points, bricks.pack(values, volume), keys, volume)


def affine_points(points: DataFrame, affine: np.ndarray) -> DataFrame:
    """x, y, z moved by a 4 x 4 matrix: column arithmetic with literals."""
    row = lambda r: sum((F.lit(float(affine[r][c])) * F.col(n) for c, n in enumerate("xyz")), F.lit(float(affine[r][3])))
    return points.withColumns({n: row(r) for r, n in enumerate("xyz")})


def enclosing_voxel(points: DataFrame, values: DataFrame, affine: np.ndarray, keys: list[str], volume: list[str] = []) -> DataFrame:  # noqa: B006
    """The value of the voxel that encloses each moved point; null outside the volume."""
    return bricks.enclosing(affine_points(points, affine), bricks.pack(values, volume), keys, volume)


def gradient(values: DataFrame, volume: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(volume, i, j, k, gi, gj, gk): central differences, one-sided at the ends of each line of adjacent voxels; 0 for a
    voxel alone on its line."""
    out = values
    for axis, size in zip(AXES, spacing, strict=True):
        by = W.partitionBy(*volume, *[a for a in AXES if a != axis]).orderBy(axis)
        here = F.col(axis)
        before = F.when(F.lag(axis).over(by) == here - 1, F.lag("value").over(by))
        after = F.when(F.lead(axis).over(by) == here + 1, F.lead("value").over(by))
        slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * size)).when(after.isNotNull(), (after - F.col("value")) / size).when(before.isNotNull(), (F.col("value") - before) / size).otherwise(0.0)
        out = out.withColumn(f"g{axis}", slope)
    return out.select(*volume, *AXES, "gi", "gj", "gk")


def bounding_box(mask: DataFrame, volume: list[str], padding: int, shape: tuple[int, int, int]) -> DataFrame:
    """Per axis the first and last voxel of a mask, padded and kept within the grid."""
    ends = [x for a, size in zip(AXES, shape, strict=True) for x in (F.greatest(F.min(a) - padding, F.lit(0)).alias(f"{a}_min"), F.least(F.max(a) + padding, F.lit(size - 1)).alias(f"{a}_max"))]
    return mask.groupBy(*volume).agg(*ends)


def label_masks(labels: DataFrame, foreground: list[int], source: list[int]) -> DataFrame:
    """Foreground, source and sink (neither) flags of every voxel."""
    f, s = F.col("label").isin(foreground), F.col("label").isin(source)
    return labels.withColumns({"foreground": f, "source": s, "sink": ~(f | s)})


def hemisphere(index: Column, per_side: int) -> tuple[Column, Column]:
    """Side and vertex of a place on a concatenated left and right axis."""
    return F.when(index < per_side, "L").otherwise("R"), index % per_side
