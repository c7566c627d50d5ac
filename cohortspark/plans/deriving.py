"""Deriving a cohort's features from its inputs: a branch for each kind of structure, all subjects in one plan.

Every branch is joins and grouped sums keyed by subject, feature and vertex, so there is no loop over subjects. A subject
whose inputs are missing has no rows; `process_cohort` lists what was asked for and is not there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import grid, mesh, series


def cortical(maps: DataFrame, points: DataFrame, edge: DataFrame, weights: DataFrame, *, sigma: float, hops: int = 2, signals: DataFrame | None = None, subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    """(subject, feature, hemi, vertex, value): maps smoothed on their mesh, then resampled to the target vertices.

    maps are (subject, feature, hemi, vertex, value). The mesh (points, edge) and the weights hold for all subjects and both sides.
    signals are (subject, hemi, vertex, values): the four features of each series are maps like the others."""
    keys = [*subject, "hemi", "vertex"]
    if signals is not None:
        features = series.packed_features(signals, keys).withColumnRenamed("timescale", "timescales")
        maps = maps.unionByName(features.unpivot(keys, ["rmssd", "timescales", "alff", "falff"], "feature", "value"))
    smoothed = mesh.smooth(maps.select(*keys, "feature", "value"), points, edge, [], sigma, hops)
    resampled = mesh.weighted_resample(smoothed, weights, [*subject, "feature", "hemi"])
    return resampled.select(*subject, "feature", "hemi", F.col("target_vertex").alias("vertex"), "value")


def sampled_maps(points: DataFrame, volumes: DataFrame, edge: DataFrame, *, sigma: float, hops: int = 2, subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    """(subject, feature, hemi, vertex, value): each subject's volumes sampled at its surface points, then smoothed on that surface.

    points are (subject, hemi, vertex, x, y, z) in voxel units, volumes (subject, feature, i, j, k, value), edge (subject, hemi, a, b)."""
    volume = [*subject, "feature"]
    wanted = points.join(volumes.select(*volume).distinct(), subject)
    values = grid.trilinear(wanted, volumes, [*volume, "hemi", "vertex"], volume)
    return mesh.smooth(values, points, edge, [*subject, "hemi"], sigma, hops).select(*volume, "hemi", "vertex", "value")


def subcortical(volumes: DataFrame, labels: DataFrame, regions: DataFrame, *, sizes: DataFrame | None = None, subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    """(subject, feature, region, value): means of each feature over each region; sizes (subject, region, value) are feature volume."""
    volume = [*subject, "feature"]
    segmented = labels.join(volumes.select(*volume).distinct(), subject)
    means = grid.region_mean(volumes, segmented, regions, volume).select(*volume, "region", "value")
    return means if sizes is None else means.unionByName(sizes.select(*subject, F.lit("volume").alias("feature"), "region", "value"))


def sampled_depth_profile(points: DataFrame, volume: DataFrame, edge: DataFrame, keys: list[str], *, sigma: float, hops: int = 2) -> DataFrame:
    """(keys, vertex, kind, slot, value): a volume sampled at every layer of a surface, its depth profile, and the raw values and
    gradients smoothed along the surface (kinds smooth_raw and smooth_gradient). points are (keys, vertex, layer, x, y, z);
    the innermost layer, 0, gives the distances along the surface."""
    at = [*keys, "vertex", "layer"]
    layers = grid.trilinear(points, volume, [*at, "x", "y", "z"])
    profile = mesh.depth_profile(layers, [*keys, "vertex"])
    along = mesh.smooth(profile.where(F.col("kind").isin("raw", "gradient")), points.where("layer = 0").drop("layer"), edge, keys, sigma, hops)
    return profile.unionByName(along.withColumn("kind", F.concat(F.lit("smooth_"), "kind")))


def process_cohort(derived: dict[str, DataFrame], requested: DataFrame, *, subject: list[str] = ["participant_id"]) -> dict[str, DataFrame]:  # noqa: B006
    """`measurements` of all structures in one table and the `status` of every requested (subject, structure, feature).

    `derived` has the frame of each structure as its branch returns it. Regions are points like vertices: the column point is
    text. Status is success or failed, with structure/feature as the reason."""
    parts = []
    for structure, frame in derived.items():
        region = "region" in frame.columns
        point = F.col("region") if region else F.col("vertex").cast("string")
        side = F.lit(None).cast("string") if region else F.col("hemi")
        parts.append(frame.select(*subject, F.lit(structure).alias("structure"), "feature", side.alias("hemi"), point.alias("point"), "value"))
    measurements = reduce(DataFrame.unionByName, parts)
    on = [*subject, "structure", "feature"]
    there = measurements.select(*on).distinct().withColumn("_p", F.lit(True))
    state = F.when(F.col("_p"), "success").otherwise("failed").alias("status")
    status = requested.select(*on).distinct().join(there, on, "left").select(*on, state, F.concat_ws("/", "structure", "feature").alias("reason"))
    return {"measurements": measurements, "status": status}
