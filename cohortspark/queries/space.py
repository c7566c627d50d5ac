"""Voxel grids, meshes, resampling and layer profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortspark import fixtures as X
from cohortspark.functions.scores import rounded
from cohortspark.operators import bricks, geodesic, grid, mesh, weights
from cohortspark.operators.bricks import AXES

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = X.with_views(views, sql) if views else sql
        return f

    return add


def _r(frame, *values, places=6):
    return frame.withColumns({c: rounded(F.col(c), places) for c in values})


@query("region_mean", "vox", ", reg AS (SELECT label, 'region' || label AS region FROM (SELECT DISTINCT label FROM vox) UNION ALL SELECT 1000, 'region1000') SELECT region, round(coalesce(avg(value), 'NaN'::DOUBLE), 6) + 0.0 AS value FROM reg LEFT JOIN vox USING (label) GROUP BY region")
def region_mean(spark, sf_dir):
    v = X.voxels(spark, sf_dir)
    names = v.select("label").distinct().union(v.select(F.lit(1000)).limit(1)).select("label", F.concat(F.lit("region"), F.col("label").cast("string")).alias("region"))
    return _r(grid.region_mean(v.drop("label"), v.drop("value"), names, []), "value")


POINTS = ", p AS (SELECT p_partkey AS id, i + 0.25 AS x, j + (p_partkey % 4) / 4.0 AS y, k + 0.5 AS z FROM (SELECT p_partkey, CAST(p_partkey % 10 AS INTEGER) AS i, CAST((p_partkey // 10) % 10 AS INTEGER) AS j, CAST(p_partkey // 100 AS INTEGER) AS k FROM part))"


def _points(spark, sf_dir):
    p = F.col("p_partkey")
    return X.table(spark, sf_dir, "part").select(p.alias("id"), ((p % 10) + 0.25).cast("double").alias("x"), (F.floor(p / 10) % 10 + (p % 4) / 4.0).cast("double").alias("y"), (F.floor(p / 100) + 0.5).cast("double").alias("z"))


@query("trilinear_sample", "vox", POINTS + ", c AS (SELECT id, CAST(floor(x) AS INTEGER) + a AS i, CAST(floor(y) AS INTEGER) + b AS j, CAST(floor(z) AS INTEGER) + c AS k, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM p, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b), (VALUES (0), (1)) cc(c)) SELECT id, round(sum(w * coalesce(value, 0)), 6) + 0.0 AS value FROM c LEFT JOIN vox USING (i, j, k) GROUP BY id")
def trilinear_sample(spark, sf_dir):
    return _r(grid.trilinear(_points(spark, sf_dir), X.voxels(spark, sf_dir), ["id"]), "value")


@query("affine_nearest_voxel", "vox", POINTS + ", m AS (SELECT id, CAST(floor(9 - y + 0.5) AS INTEGER) AS i, CAST(floor(x + 0.5 + 0.5) AS INTEGER) AS j, CAST(floor(z - 0.25 + 0.5) AS INTEGER) AS k FROM p) SELECT id, round(value, 6) + 0.0 AS value FROM m LEFT JOIN vox USING (i, j, k)")
def affine_nearest_voxel(spark, sf_dir):
    turn = np.array([[0.0, -1, 0, 9], [1, 0, 0, 0.5], [0, 0, 1, -0.25], [0, 0, 0, 1]])
    return _r(grid.enclosing_voxel(_points(spark, sf_dir), X.voxels(spark, sf_dir), turn, ["id"]), "value")


BOX = "SELECT CAST(a.i AS BIGINT) AS i, CAST(a.j AS BIGINT) AS j, CAST(a.k AS BIGINT) AS k, round({mean}, 6) + 0.0 AS value FROM v a JOIN v b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL"
HOLES = ", v AS (SELECT i, j, k, CASE WHEN label % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM vox WHERE label % 7 <> 3)"


def _box(frame):
    return grid.box_mean(frame, []).select(*AXES, rounded(F.col("value")).alias("value"))


@query("box_mean_3d", "vox", ", v AS (SELECT * FROM vox) " + BOX.format(mean="sum(b.value) / 27"))
def box_mean_3d(spark, sf_dir):
    """A volume without NaN: zeros beyond its border, so every sum is over 27."""
    return _box(X.voxels(spark, sf_dir).drop("label"))


@query("box_mean_holes", "vox", HOLES + " " + BOX.format(mean="coalesce(avg(b.value) FILTER (NOT isnan(b.value)), 'NaN'::DOUBLE)"))
def box_mean_holes(spark, sf_dir):
    """A volume with NaN and with voxels missing: the mean is over what is there."""
    return _box(X.voxels(spark, sf_dir).where("label % 7 <> 3").withColumn("value", F.when(F.col("label") % 5 == 0, float("nan")).otherwise(F.col("value"))).drop("label"))


@query("trilinear_volumes", "vox", POINTS + ", vol AS (SELECT label % 3 AS volume, i, j, k, value FROM vox UNION ALL SELECT 3, i, j, k, -value FROM vox), q AS (SELECT volume, id, x - 0.75 AS x, y, z FROM p, (VALUES (0), (1), (2), (3)) w(volume)), c AS (SELECT volume, id, CAST(floor(x) AS INTEGER) + a AS i, CAST(floor(y) AS INTEGER) + b AS j, CAST(floor(z) AS INTEGER) + c AS k, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM q, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b), (VALUES (0), (1)) cc(c)) SELECT CAST(volume AS BIGINT) AS volume, id, round(sum(w * coalesce(value, 0)), 6) + 0.0 AS value FROM c LEFT JOIN vol USING (volume, i, j, k) GROUP BY volume, id")
def trilinear_volumes(spark, sf_dir):
    """Four volumes in one table of bricks, three of them with gaps, sampled at the same points, some beyond the border."""
    v = X.voxels(spark, sf_dir)
    packed = bricks.pack(v.withColumn("volume", F.col("label") % 3).unionByName(v.withColumns({"volume": F.lit(3), "value": -F.col("value")})), ["volume"])
    points = _points(spark, sf_dir).withColumns({"x": F.col("x") - 0.75, "volume": F.explode(F.array(*map(F.lit, range(4))))})
    out = bricks.trilinear(points, packed, ["volume", "id"], ["volume"])
    return _r(out.withColumn("volume", F.col("volume").cast("bigint")), "value")


def _slope(axis: str, size: float) -> str:
    rest = ", ".join(a for a in "ijk" if a != axis)
    w = f"OVER (PARTITION BY {rest} ORDER BY {axis})"
    b, a = f"(CASE WHEN lag({axis}) {w} = {axis} - 1 THEN lag(value) {w} END)", f"(CASE WHEN lead({axis}) {w} = {axis} + 1 THEN lead(value) {w} END)"
    return f"CASE WHEN {b} IS NOT NULL AND {a} IS NOT NULL THEN ({a} - {b}) / (2 * {size}) WHEN {a} IS NOT NULL THEN ({a} - value) / {size} WHEN {b} IS NOT NULL THEN (value - {b}) / {size} ELSE 0.0 END"


@query("grid_gradient", "vox", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, round({_slope('i', 0.5)}, 6) + 0.0 AS gi, round({_slope('j', 1.0)}, 6) + 0.0 AS gj, round({_slope('k', 2.0)}, 6) + 0.0 AS gk FROM vox")
def grid_gradient(spark, sf_dir):
    out = grid.gradient(X.voxels(spark, sf_dir).drop("label"), [], (0.5, 1.0, 2.0))
    return _r(out.select(*[F.col(a).cast("bigint").alias(a) for a in "ijk"], "gi", "gj", "gk"), "gi", "gj", "gk")


@query("mask_bbox", "vox", "SELECT label, " + ", ".join(f"CAST(greatest(min({a}) - 1, 0) AS BIGINT) AS {a}_min, CAST(least(max({a}) + 1, {n}) AS BIGINT) AS {a}_max" for a, n in (("i", 9), ("j", 9), ("k", 999))) + " FROM vox WHERE value > 500 GROUP BY label")
def mask_bbox(spark, sf_dir):
    out = grid.bounding_box(X.voxels(spark, sf_dir).where("value > 500"), ["label"], 1, (10, 10, 1000))
    return out.select("label", *[F.col(c).cast("bigint").alias(c) for c in out.columns if c != "label"])


@query("label_masks", "vox", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, label, label IN (1, 2, 3, 10, 20) AS foreground, label IN (4, 5) AS source, label NOT IN (1, 2, 3, 10, 20, 4, 5) AS sink FROM vox")
def label_masks(spark, sf_dir):
    out = grid.label_masks(X.voxels(spark, sf_dir), [1, 2, 3, 10, 20], [4, 5])
    return out.select(*[F.col(a).cast("bigint").alias(a) for a in "ijk"], "label", "foreground", "source", "sink")


def _edges(spark, sf_dir):
    return mesh.edges(X.mesh_triangles(spark, sf_dir), [])


@query("mesh_edges", "mv mt me", "SELECT a, b FROM me")
def mesh_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("neighbour_impute", "mv mt me", ", n AS (SELECT me.a AS vertex, avg(mv.value) AS m FROM me JOIN mv ON mv.vertex = me.b GROUP BY me.a) SELECT vertex, round(CASE WHEN value = 0 THEN coalesce(m, 0) ELSE value END, 6) + 0.0 AS value FROM mv LEFT JOIN n USING (vertex)")
def neighbour_impute(spark, sf_dir):
    return _r(mesh.neighbour_impute(X.mesh_vertices(spark, sf_dir).select("vertex", "value"), _edges(spark, sf_dir), [], ["value"]), "value")


@query("mesh_smooth", "mv mt me", ", h AS (SELECT vertex AS a, vertex AS b FROM mv UNION SELECT a, b FROM me UNION SELECT x.a, y.b FROM me x JOIN me y ON x.b = y.a), w AS (SELECT h.a, q.value, exp(-((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) / (2 * 1.5 * 1.5)) AS w FROM h JOIN mv p ON p.vertex = h.a JOIN mv q ON q.vertex = h.b) SELECT a AS vertex, round(sum(w * value) / sum(w), 6) + 0.0 AS value FROM w GROUP BY a")
def mesh_smooth(spark, sf_dir):
    v = X.mesh_vertices(spark, sf_dir)
    return _r(mesh.smooth(v.select("vertex", "value"), v.select("vertex", "x", "y", "z"), _edges(spark, sf_dir), [], 1.5, hops=2), "value")


LENGTH = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))"
#: Edges are 1 or longer, so paths of up to 3.2 have three edges at most.
PATHS = f", g AS (SELECT a, b, {LENGTH} AS d FROM me JOIN mv p ON p.vertex = a JOIN mv q ON q.vertex = b), two AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM g x JOIN g y ON x.b = y.a GROUP BY ALL), three AS (SELECT x.a, y.b, min(x.d + y.d) AS d FROM two x JOIN g y ON x.b = y.a GROUP BY ALL), geo AS (SELECT a, b, min(d) AS d FROM (SELECT vertex AS a, vertex AS b, 0.0 AS d FROM mv UNION ALL SELECT * FROM g UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) WHERE d <= 3.2 GROUP BY a, b)"


def _sheet(spark, sf_dir):
    return X.mesh_vertices(spark, sf_dir).select("vertex", "x", "y", "z"), _edges(spark, sf_dir)


@query("mesh_distances", "mv mt me", PATHS + " SELECT a, b, round(d, 6) + 0.0 AS distance FROM geo")
def mesh_distances(spark, sf_dir):
    return _r(geodesic.distances(*_sheet(spark, sf_dir), [], 3.2), "distance")


@query("mesh_smooth_along", "mv mt me", PATHS + ", m AS (SELECT vertex, CASE WHEN vertex % 11 > 2 THEN value END AS value FROM mv) SELECT a AS vertex, round(sum(exp(-d * d / (2 * 1.2 * 1.2)) * value) / sum(exp(-d * d / (2 * 1.2 * 1.2))) FILTER (value IS NOT NULL), 6) + 0.0 AS value FROM geo JOIN m ON m.vertex = b GROUP BY a")
def mesh_smooth_along(spark, sf_dir):
    """Weights of the distance along the sheet, over the vertices that have a value."""
    values = X.mesh_vertices(spark, sf_dir).select("vertex", F.when(F.col("vertex") % 11 > 2, F.col("value")).alias("value"))
    return _r(mesh.smooth_along(values, *_sheet(spark, sf_dir), [], 1.2, 3.2), "value")


@query("nearest_resample", "mv", ", t AS (SELECT s_suppkey AS target, (s_suppkey * 7 % 200) / 10.0 AS x, (s_suppkey * 13 % 97) / 10.0 AS y, 0.5 AS z FROM supplier), d AS (SELECT target, vertex AS source, value, (t.x - mv.x) * (t.x - mv.x) + (t.y - mv.y) * (t.y - mv.y) + (t.z - mv.z) * (t.z - mv.z) AS d2 FROM t, mv) SELECT target, arg_min(source, (d2, source)) AS source, round(arg_min(value, (d2, source)), 6) + 0.0 AS value FROM d GROUP BY target".replace("arg_min(source, (d2, source))", "min(source) FILTER (d2 = best)").replace("arg_min(value, (d2, source))", "min_by(value, source) FILTER (d2 = best)").replace("FROM d GROUP BY target", "FROM (SELECT *, min(d2) OVER (PARTITION BY target) AS best FROM d) GROUP BY target"))
def nearest_resample(spark, sf_dir):
    s = F.col("s_suppkey")
    targets = X.table(spark, sf_dir, "supplier").select(s.alias("target"), (s * 7 % 200 / 10.0).alias("x"), (s * 13 % 97 / 10.0).alias("y"), F.lit(0.5).alias("z"))
    sources = X.mesh_vertices(spark, sf_dir).withColumnRenamed("vertex", "source")
    out = mesh.nearest_resample(targets, sources, 64)
    return out.select("target", "source", rounded(F.col("value")).alias("value"))


def _weights(spark, sf_dir):
    """Every order line is a weight from its part to its supplier, normalised over the supplier."""
    l = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target_vertex"), F.col("l_partkey").alias("source_vertex")).agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    total = l.groupBy("target_vertex").agg(F.sum("q").alias("t"))
    return l.join(total, "target_vertex").select("target_vertex", "source_vertex", (F.col("q") / F.col("t")).alias("weight"))


WT = ", q AS (SELECT l_suppkey AS target_vertex, l_partkey AS source_vertex, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), w AS (SELECT target_vertex, source_vertex, q / sum(q) OVER (PARTITION BY target_vertex) AS weight FROM q)"


@query("weighted_resample", "mv", WT + " SELECT target_vertex, round(sum(weight * value), 5) + 0.0 AS value FROM w JOIN mv ON vertex = source_vertex GROUP BY target_vertex")
def weighted_resample(spark, sf_dir):
    return _r(mesh.weighted_resample(X.mesh_vertices(spark, sf_dir).select("vertex", "value"), _weights(spark, sf_dir), []), "value", places=5)


@query("largest_resample", "mv", WT + ", k AS (SELECT target_vertex, value, row_number() OVER (PARTITION BY target_vertex ORDER BY weight DESC, source_vertex) AS rn FROM w JOIN mv ON vertex = source_vertex) SELECT target_vertex, round(value, 6) + 0.0 AS value FROM k WHERE rn = 1")
def largest_resample(spark, sf_dir):
    return _r(mesh.largest_resample(X.mesh_vertices(spark, sf_dir).select("vertex", "value"), _weights(spark, sf_dir), []), "value")


#: Suppliers as a coarser sheet of 10 points a row over the sheet of parts, and two flat meshes' barycentric weights in SQL.
SHEET = "sv AS (SELECT s_suppkey AS vertex, 1.9 * (s_suppkey % 10) + 0.3 AS x, 1.7 * (s_suppkey // 10) + 0.4 AS y, 0.0 AS z FROM supplier), st AS (SELECT vertex AS v0, vertex + 1 AS v1, vertex + 10 AS v2 FROM sv c WHERE vertex % 10 < 9 AND EXISTS (SELECT 1 FROM sv f WHERE f.vertex = c.vertex + 11) UNION ALL SELECT vertex + 1, vertex + 11, vertex + 10 FROM sv c WHERE vertex % 10 < 9 AND EXISTS (SELECT 1 FROM sv f WHERE f.vertex = c.vertex + 11))"


def _flat_sql(name: str, targets: str, points: str, triangles: str) -> str:
    area = lambda a, b, c: f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({c}.x - {a}.x) * ({b}.y - {a}.y))"
    shares = ", ".join(f"{area(*[('t' if m == n else f'p{m}') for m in range(3)])} / {area('p0', 'p1', 'p2')} AS l{n}" for n in range(3))
    joins = " ".join(f"JOIN {points} p{n} ON p{n}.vertex = v{n}" for n in range(3))
    hit = f"{name}_h AS (SELECT t.vertex AS target_vertex, v0, v1, v2, {shares} FROM {triangles} {joins} JOIN {targets} t ON t.x BETWEEN least(p0.x, p1.x, p2.x) - 1e-6 AND greatest(p0.x, p1.x, p2.x) + 1e-6 AND t.y BETWEEN least(p0.y, p1.y, p2.y) - 1e-6 AND greatest(p0.y, p1.y, p2.y) + 1e-6)"
    one = f"{name}_1 AS (SELECT *, row_number() OVER (PARTITION BY target_vertex ORDER BY least(l0, l1, l2) DESC, v0, v1, v2) AS rn FROM {name}_h WHERE least(l0, l1, l2) >= -1e-9)"
    three = " UNION ALL ".join(f"SELECT target_vertex, v{n} AS source_vertex, l{n} AS l FROM {name}_1 WHERE rn = 1 AND l{n} > 1e-9" for n in range(3))
    return f"{hit}, {one}, {name} AS (SELECT target_vertex, source_vertex, l / sum(l) OVER (PARTITION BY target_vertex) AS weight FROM ({three}))"


FORWARD = _flat_sql("fw", "sv", "mv", "mt")
AREAS = "ar AS (SELECT vertex, sum(t) AS area FROM (SELECT unnest([v0, v1, v2]) AS vertex, sqrt(pow((q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y), 2) + pow((q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z), 2) + pow((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x), 2)) / 6 AS t FROM mt JOIN mv p ON p.vertex = v0 JOIN mv q ON q.vertex = v1 JOIN mv r ON r.vertex = v2) GROUP BY vertex)"


def _coarse(spark, sf_dir):
    s = F.col("s_suppkey")
    points = X.table(spark, sf_dir, "supplier").select(s.alias("vertex"), (1.9 * (s % 10) + 0.3).alias("x"), (1.7 * F.floor(s / 10) + 0.4).alias("y"), F.lit(0.0).alias("z"))
    corner = points.where("vertex % 10 < 9").select("vertex").join(points.select((F.col("vertex") - 11).alias("vertex")), "vertex")
    a, b, c, d = (F.col("vertex") + n for n in (0, 1, 10, 11))
    return points, corner.select(F.explode(F.array(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")), F.struct(b.alias("v0"), d.alias("v1"), c.alias("v2")))).alias("t")).select("t.*")


@query("barycentric_weights", "mv mt", f", {SHEET}, {FORWARD} SELECT target_vertex, source_vertex, round(weight, 6) + 0.0 AS weight FROM fw")
def barycentric_weights(spark, sf_dir):
    targets = _coarse(spark, sf_dir)[0].withColumnRenamed("vertex", "target")
    return _r(weights.barycentric_weights(targets, X.mesh_vertices(spark, sf_dir), X.mesh_triangles(spark, sf_dir), flat=True), "weight")


@query("barycentric_largest", "mv mt", f", {SHEET}, {FORWARD} SELECT target_vertex, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY target_vertex ORDER BY round(weight, 9) DESC, source_vertex) AS rn FROM fw JOIN mv ON vertex = source_vertex) WHERE rn = 1")
def barycentric_largest(spark, sf_dir):
    """A map resampled by the largest of its barycentric weights."""
    targets = _coarse(spark, sf_dir)[0].withColumnRenamed("vertex", "target")
    w = weights.barycentric_weights(targets, X.mesh_vertices(spark, sf_dir), X.mesh_triangles(spark, sf_dir), flat=True)
    return _r(mesh.largest_resample(X.mesh_vertices(spark, sf_dir).select("vertex", "value"), _r(w, "weight", places=9), []), "value")


@query("adaptive_weights", "mv mt", f", {SHEET}, {FORWARD}, {_flat_sql('bw', 'mv', 'sv', 'st')}, {AREAS}, ways AS (SELECT w.*, weight * area AS u, count(*) OVER (PARTITION BY target_vertex, way) AS n FROM (SELECT *, 1 AS way FROM fw UNION ALL SELECT source_vertex, target_vertex, weight, 0 FROM bw) w JOIN ar ON vertex = source_vertex), pick AS (SELECT *, first_value(way) OVER (PARTITION BY target_vertex ORDER BY n DESC, way DESC) AS best FROM ways) SELECT target_vertex, source_vertex, round(u / sum(u) OVER (PARTITION BY target_vertex), 6) + 0.0 AS weight FROM pick WHERE way = best")
def adaptive_weights(spark, sf_dir):
    """Weights by area from the sheet of parts to the coarser one of suppliers."""
    source = X.mesh_vertices(spark, sf_dir), X.mesh_triangles(spark, sf_dir)
    return _r(weights.adaptive_weights(source, _coarse(spark, sf_dir), flat=True), "weight")


@query("region_to_vertex", None, "SELECT participant_id, region, CAST(nth AS BIGINT) AS nth, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT s_suppkey AS participant_id, region, unnest(range(0, n)) AS nth FROM supplier, (SELECT 'r' || r_regionkey AS region, r_regionkey + 2 AS n FROM region)) g LEFT JOIN (SELECT s_suppkey AS p, 'r' || n_regionkey AS rr, s_acctbal AS value FROM supplier JOIN nation ON n_nationkey = s_nationkey) v ON v.p = participant_id AND v.rr = region")
def region_to_vertex(spark, sf_dir):
    home = X.table(spark, sf_dir, "supplier").join(X.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("participant_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"), F.col("s_acctbal").alias("value"))
    sizes = X.table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("region"), (F.col("r_regionkey") + 2).cast("int").alias("n_vertices"))
    return _r(mesh.region_to_vertex(home, sizes, ["participant_id"]).withColumn("nth", F.col("nth").cast("bigint")), "value")


LAYER_KEYS = ["subject_id", "vertex"]
STEP = ", st AS (SELECT subject_id, vertex, layer, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS distance, value - lag(value) OVER w AS step FROM ly WINDOW w AS (PARTITION BY subject_id, vertex ORDER BY layer)), g AS (SELECT subject_id, vertex, layer, distance, CASE WHEN distance > 0 THEN step / distance ELSE 0.0 END AS gradient FROM st WHERE distance IS NOT NULL)"


@query("layer_gradient", "ly", STEP + " SELECT subject_id, vertex, CAST(layer AS BIGINT) AS layer, round(distance, 6) + 0.0 AS distance, round(gradient, 4) + 0.0 AS gradient FROM g")
def layer_gradient(spark, sf_dir):
    out = mesh.layer_gradient(X.layers(spark, sf_dir), LAYER_KEYS)
    return out.select(*LAYER_KEYS, F.col("layer").cast("bigint").alias("layer"), rounded(F.col("distance")).alias("distance"), rounded(F.col("gradient"), 4).alias("gradient"))


DEPTH = ", sp AS (SELECT subject_id, vertex, unnest(range(0, 12)) AS slot FROM (SELECT DISTINCT subject_id, vertex FROM g)), dp AS (SELECT subject_id, vertex, slot, -coalesce((SELECT sum(distance) FROM g WHERE g.subject_id = sp.subject_id AND g.vertex = sp.vertex AND layer - 1 >= slot AND layer - 1 <= 4 AND EXISTS (SELECT 1 FROM g g2 WHERE g2.subject_id = sp.subject_id AND g2.vertex = sp.vertex AND g2.layer - 1 = slot)), 0.0) + coalesce((SELECT sum(distance) FROM g WHERE g.subject_id = sp.subject_id AND g.vertex = sp.vertex AND layer - 1 > 4 AND layer <= slot AND EXISTS (SELECT 1 FROM g g2 WHERE g2.subject_id = sp.subject_id AND g2.vertex = sp.vertex AND g2.layer = slot)), 0.0) AS depth FROM sp)"


@query("signed_depth", "ly", STEP + DEPTH + " SELECT subject_id, vertex, CAST(slot AS BIGINT) AS slot, round(depth, 6) + 0.0 AS depth FROM dp")
def signed_depth(spark, sf_dir):
    steps = mesh.layer_gradient(X.layers(spark, sf_dir), LAYER_KEYS).select(*LAYER_KEYS, (F.col("layer") - 1).alias("e"), "distance")
    return mesh.signed_depth(steps, LAYER_KEYS).select(*LAYER_KEYS, F.col("slot").cast("bigint").alias("slot"), rounded(F.col("depth")).alias("depth"))


@query("depth_profile", "ly", STEP + DEPTH + " SELECT subject_id, vertex, 'raw' AS kind, CAST(layer AS BIGINT) AS slot, round(value, 6) + 0.0 AS value FROM ly UNION ALL SELECT subject_id, vertex, 'distance', layer, round(distance, 6) + 0.0 FROM g UNION ALL SELECT subject_id, vertex, 'gradient', layer, round(gradient, 4) + 0.0 FROM g UNION ALL SELECT subject_id, vertex, 'depth', slot, round(depth, 6) + 0.0 FROM dp")
def depth_profile(spark, sf_dir):
    out = mesh.depth_profile(X.layers(spark, sf_dir), LAYER_KEYS)
    return out.select(*LAYER_KEYS, "kind", F.col("slot").cast("bigint").alias("slot"), F.when(F.col("kind") == "gradient", rounded(F.col("value"), 4)).otherwise(rounded(F.col("value"))).alias("value"))
