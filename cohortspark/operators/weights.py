"""Resampling weights from geometry: which triangle a point is in, and where in it.

On a sphere around the origin a point is in the triangle that its ray from the centre meets; on a flat mesh x and y alone
count. Triangles and points meet by an equality join on cells. A triangle's cells are as wide as its box, to the next power
of two, so it lies in eight of them at most, however different the triangles' sizes are; points look at a cell of each width in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: How far outside a triangle, in barycentric coordinates, rounding may put a point on its border.
ON_BORDER = 1e-9


def _direction(flat: bool) -> list[Column]:
    if flat:
        return [F.col("x").cast("double"), F.col("y").cast("double"), F.lit(1.0)]
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return [F.when(norm > 0, F.col(c) / norm) for c in "xyz"]


def _det(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Determinant of three vectors, by the differences to the first: small triangles far out keep their digits."""
    b, c = [x - y for x, y in zip(b, a, strict=True)], [x - y for x, y in zip(c, a, strict=True)]
    return a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def barycentric_weights(targets: DataFrame, points: DataFrame, triangles: DataFrame, *, flat: bool = False) -> DataFrame:
    """(target_vertex, source_vertex, weight): each target's position in its triangle of the source mesh; a target's weights are
    positive and sum to 1.

    targets are (target, x, y, z), points (vertex, x, y, z), triangles (v0, v1, v2). A target on a border has the corners of that
    border only, whichever triangle it is given to; of several triangles the one it is deepest in counts, then the one with the
    smallest corners. Targets in no triangle, in the centre or without finite coordinates have no weights; triangles without area
    hold nothing."""
    axes = 2 if flat else 3
    finite = lambda: F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in "xyz"))
    at = points.where(finite()).select("vertex", F.array(*_direction(flat)).alias("u"))
    corners = triangles.select("v0", "v1", "v2").distinct()
    for n in range(3):
        corners = corners.join(at.select(F.col("vertex").alias(f"v{n}"), F.col("u").alias(f"u{n}")), f"v{n}")
    u = lambda n: [F.col(f"u{n}")[c] for c in range(3)]
    low, high = [F.least(*[u(n)[c] for n in range(3)]) for c in range(axes)], [F.greatest(*[u(n)[c] for n in range(3)]) for c in range(axes)]
    width = F.greatest(*[h - l for l, h in zip(low, high, strict=True)])  # noqa: E741
    # a spherical triangle bulges over its corners' plane by less than a third of its longest edge's square
    bulge = F.lit(1e-12) if flat else F.least(width * width, F.lit(1.0)) + 1e-12
    boxed = corners.withColumn("bulge", bulge).withColumn("level", F.ceil(F.log2(width + 2 * F.col("bulge"))).cast("int"))
    boxed = boxed.withColumn("det", _det(u(0), u(1), u(2))).where("abs(det) > 0")
    side = F.pow(F.lit(2.0), F.col("level"))
    for c in range(axes):
        boxed = boxed.withColumn(f"c{c}", F.explode(F.sequence(F.floor((low[c] - F.col("bulge")) / side), F.floor((high[c] + F.col("bulge")) / side))))
    levels = [r["level"] for r in boxed.select("level").distinct().collect()]  # powers of two between the smallest and largest triangle
    looking = targets.where(finite()).select(F.col("target").alias("target_vertex"), F.array(*_direction(flat)).alias("p")).where("p[0] is not null")
    looking = looking.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = [F.col("p")[c] for c in range(3)]
    looking = looking.withColumns({f"c{c}": F.floor(p[c] / side) for c in range(axes)})
    met = looking.join(boxed, ["level", *[f"c{c}" for c in range(axes)]])
    parts = [_det(p, u((n + 1) % 3), u((n + 2) % 3)) / F.col("det") for n in range(3)]
    met = met.withColumns({f"l{n}": x for n, x in enumerate(parts)}).withColumn("sum", F.expr("l0 + l1 + l2")).where("sum > 0")
    least = F.least("l0", "l1", "l2") / F.col("sum")
    inside = met.withColumn("least", least).where(F.col("least") >= -ON_BORDER)
    best = inside.groupBy("target_vertex").agg(F.max(F.struct("least", -F.col("v0"), -F.col("v1"), -F.col("v2"), "l0", "l1", "l2", "sum", F.struct("v0", "v1", "v2").alias("v"))).alias("m"))
    share = lambda n: F.struct(F.col(f"m.v.v{n}").alias("source_vertex"), F.when(F.col(f"m.l{n}") / F.col("m.sum") > ON_BORDER, F.col(f"m.l{n}")).otherwise(0.0).alias("w"))
    three = best.select("target_vertex", F.array(*[share(n) for n in range(3)]).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["w"])
    return three.withColumn("t", total).select("target_vertex", "t", F.explode("s").alias("s")).where("s.w > 0").select("target_vertex", "s.source_vertex", (F.col("s.w") / F.col("t")).alias("weight"))


def vertex_areas(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vertex, area): a third of the area of each triangle around a vertex."""
    sides = triangles.select("v0", "v1", "v2")
    for n in range(3):
        sides = sides.join(points.select(F.col("vertex").alias(f"v{n}"), *[F.col(c).cast("double").alias(f"{c}{n}") for c in "xyz"]), f"v{n}")
    a, b = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    third = F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 6
    return sides.select(F.explode(F.array("v0", "v1", "v2")).alias("vertex"), third.alias("t")).groupBy("vertex").agg(F.sum("t").alias("area"))


def adaptive_weights(source: tuple[DataFrame, DataFrame], target: tuple[DataFrame, DataFrame], *, flat: bool = False) -> DataFrame:
    """(target_vertex, source_vertex, weight) between two meshes, each (points, triangles): weights by area, summing to 1.

    Where the target mesh is coarser than the source, a triangle's three corners would leave most sources out. So
    weights are worked out both ways: a target's position among the sources, and the sources' positions among the targets, turned
    round. Each target takes the way that gives it more sources (its own position if as many), and weights them by their areas."""
    (points, triangles), (t_points, t_triangles) = source, target
    name = lambda frame: frame.withColumnRenamed("vertex", "target")
    forward = barycentric_weights(name(t_points), points, triangles, flat=flat).withColumn("way", F.lit(1))
    back = barycentric_weights(name(points), t_points, t_triangles, flat=flat)
    back = back.select(F.col("source_vertex").alias("target_vertex"), F.col("target_vertex").alias("source_vertex"), "weight", F.lit(0).alias("way"))
    both = forward.unionByName(back).join(vertex_areas(points, triangles).withColumnRenamed("vertex", "source_vertex"), "source_vertex")
    both = both.withColumn("n", F.count("*").over(W.partitionBy("target_vertex", "way"))).withColumn("w", F.col("weight") * F.col("area"))
    first = F.max(F.struct("n", "way")).over(W.partitionBy("target_vertex"))
    chosen = both.withColumn("best", first["way"]).where("way = best")
    return chosen.select("target_vertex", "source_vertex", (F.col("w") / F.sum("w").over(W.partitionBy("target_vertex"))).alias("weight"))
