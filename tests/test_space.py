"""Voxel bricks, nearest neighbours over adaptive cells, weights from geometry and geodesic kernels against numpy."""

import heapq
import math

import numpy as np
import pytest

from cohortspark.operators import bricks, geodesic, grid, mesh, nearest, weights


def voxels(spark, a, volume=None):
    rows = [(*at, float(x)) if volume is None else (volume, *at, float(x)) for at, x in np.ndenumerate(a) for at in [tuple(map(int, at))]]
    return spark.createDataFrame(rows, ("" if volume is None else "v string, ") + "i int, j int, k int, value double")


def boxed(a):
    """The rule of the definition, on a whole array."""
    pad = np.pad(a, 1, constant_values=np.nan)
    part = np.stack([pad[i : i + a.shape[0], j : j + a.shape[1], k : k + a.shape[2]] for i in range(3) for j in range(3) for k in range(3)])
    total, n = np.nansum(part, 0), (~np.isnan(part)).sum(0)
    return np.where(n > 0, total / np.where(n > 0, n, 1), np.nan) if np.isnan(a).any() else total / 27


def test_box_means_by_volume(spark):
    r = np.random.default_rng(4)
    whole, holes = r.normal(size=(9, 17, 8)), r.normal(size=(6, 5, 11))
    holes[1:5, 0:4, 2:7] = np.nan
    frame = voxels(spark, whole, "whole").unionByName(voxels(spark, holes, "holes")).repartition(3)
    got = {(x["v"], x["i"], x["j"], x["k"]): x["value"] for x in grid.box_mean(frame, ["v"]).collect()}
    assert len(got) == whole.size + holes.size
    for name, a in (("whole", whole), ("holes", holes)):
        for at, want in np.ndenumerate(boxed(a)):
            x = got[name, *at]
            assert math.isnan(x) if math.isnan(want) else math.isclose(x, want, abs_tol=1e-12)
    # voxels at negative places, null values, and no voxel at all
    odd = spark.createDataFrame([(-1, -8, -9, 2.0), (0, -8, -9, None), (0, -7, -9, 4.0)], "i int, j int, k int, value double")
    assert {(x["i"], x["j"], x["k"]): x["value"] for x in grid.box_mean(odd, []).collect()} == {(-1, -8, -9): 3.0, (0, -8, -9): 3.0, (0, -7, -9): 3.0}
    assert grid.box_mean(frame.where("false"), ["v"]).collect() == []


def interpolated(a, p):
    low = np.floor(p).astype(int)
    out = 0.0
    for d in np.ndindex(2, 2, 2):
        at = low + d
        if (at >= 0).all() and (at < a.shape).all():
            out += np.prod(np.where(d, p - low, 1 - (p - low))) * a[tuple(at)]
    return out


def test_points_join_one_brick(spark):
    r = np.random.default_rng(5)
    one, two = r.normal(size=(17, 9, 10)), r.normal(size=(3, 20, 8))
    packed = bricks.pack(voxels(spark, one, "one").unionByName(voxels(spark, two, "two")), ["v"])
    points = np.vstack([r.uniform(-2, 20, (300, 3)), [[7.5, 7.5, 7.5], [8, 8, 8], [-0.5, 0, 0], [15.999, 7.999, 8.001]]])
    rows = [(v, i, *map(float, p)) for v in ("one", "two") for i, p in enumerate(points)] + [("none", 0, 1.0, 1.0, 1.0), ("one", 1000, None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "v string, id int, x double, y double, z double")
    out = bricks.trilinear(frame, packed, ["v", "id"], ["v"])
    got = {(x["v"], x["id"]): x["value"] for x in out.collect()}
    assert len(got) == len(rows) and got["one", 1000] is None and got["none", 0] == 0.0
    for v, a in (("one", one), ("two", two)):
        for i, p in enumerate(points):
            assert math.isclose(got[v, i], interpolated(a, p), abs_tol=1e-12)
    spot = {(x["v"], x["id"]): x["value"] for x in bricks.enclosing(frame, packed, ["v", "id"], ["v"]).collect()}
    for i, p in enumerate(points):
        at = np.floor(p + 0.5).astype(int)
        assert spot["one", i] == (one[tuple(at)] if (at >= 0).all() and (at < one.shape).all() else None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # a row for each point, whatever it is interpolated from


def nearest_by_all_pairs(targets, sources):
    out = []
    for t in targets:
        d = ((t - sources) * (t - sources)) @ np.ones(3)
        out.append(int(np.flatnonzero(d == d.min())[0]))
    return out


def test_nearest_of_clustered_points(spark):
    r = np.random.default_rng(6)
    centres = r.uniform(-100, 100, (30, 3))
    s = centres[r.integers(0, 30, 100_000)] + r.normal(size=(100_000, 3)) * r.choice([0.01, 1.0, 8.0], (100_000, 1))
    t = np.vstack([s[:300] + r.normal(size=(300, 3)) * 0.1, r.uniform(-150, 150, (300, 3)), r.normal(size=(60, 3)) * 1e5, np.zeros((3, 3))])
    source = spark.createDataFrame([(i, *map(float, p), float(-i)) for i, p in enumerate(s)], "source long, x double, y double, z double, value double").repartition(4)
    target = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)], "target long, x double, y double, z double")
    rows = mesh.nearest_resample(target, source).collect()
    want = nearest_by_all_pairs(t, s)
    assert {x["target"]: (x["source"], x["value"]) for x in rows} == {i: (j, -j) for i, j in enumerate(want)}
    assert all(math.isclose(x["d2"], ((t[x["target"]] - s[x["source"]]) ** 2).sum(), rel_tol=1e-9) for x in rows)
    # cells hold about the same, however dense the cluster, and few targets probe more than a few of them
    tree = nearest.plant(source, len(s))
    sizes = np.array([x["count"] for x in nearest.in_cells(source, tree).groupBy("cell").count().collect()])
    assert len(sizes) == tree.cells == 128 and sizes.max() < 4 * np.median(sizes)
    probed = np.bincount(tree.probes(t[:600])[0], minlength=600)
    assert np.median(probed) <= 4 and probed.min() >= 1


def test_nearest_with_ties_and_hot_places(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    source = spark.createDataFrame([(i, 0.0 if i % 2 else float(i // 2 % 5), 0.0, 0.0, str(i)) for i in range(900, 0, -1)], "source long, x double, y double, z double, value string")
    target = spark.createDataFrame([(i, 0.5 * (i % 3), 0.0, 0.0) for i in range(300)], "target long, x double, y double, z double")
    rows = {x["target"]: (x["source"], x["value"], x["d2"]) for x in nearest.nearest_resample(target, source, 4).collect()}
    first = {0.0: (1, "1", 0.0), 0.5: (1, "1", 0.25), 1.0: (2, "2", 0.0)}
    assert rows == {i: first[0.5 * (i % 3)] for i in range(300)}


def test_smoothing_beside_nulls(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vertex int, x double, y double, z double")
    edge = mesh.edges(spark.createDataFrame([(0, 1, 2)], "v0 int, v1 int, v2 int"), [])
    values = spark.createDataFrame([("a", 0, 10.0), ("a", 1, None), ("a", 2, None), ("b", 0, None), ("b", 1, None), ("b", 2, None)], "m string, vertex int, value double")
    got = {(x["m"], x["vertex"]): x["value"] for x in mesh.smooth(values, points, edge, [], 1.0, 1).collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 10.0, ("a", 2): 10.0, ("b", 0): None, ("b", 1): None, ("b", 2): None}


def sphere(rounds):
    """An octahedron with its triangles cut in four, again and again, on the unit sphere."""
    v = [np.array(p, float) for p in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    t = [(a, b, c) for a in (0, 1) for b in (2, 3) for c in (4, 5)]
    for _ in range(rounds):
        middle, out = {}, []

        def mid(a, b, middle=middle):
            key = (min(a, b), max(a, b))
            if key not in middle:
                m = v[a] + v[b]
                v.append(m / np.linalg.norm(m))
                middle[key] = len(v) - 1
            return middle[key]

        for a, b, c in t:
            ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
            out += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        t = out
    return np.array(v), t


def mesh_frames(spark, v, t):
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vertex long, x double, y double, z double")
    return points, spark.createDataFrame([tuple(map(int, x)) for x in t], "v0 long, v1 long, v2 long")


def test_weights_on_a_sphere(spark):
    v, t = sphere(3)
    r = np.random.default_rng(7)
    p = np.vstack([r.normal(size=(400, 3)) * r.uniform(0.1, 50, (400, 1)), v[:20] * 3, (v[t[0][0]] + v[t[0][1]])[None]])
    targets = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(9000, 0.0, 0.0, 0.0), (9001, None, 0.0, 1.0)], "target long, x double, y double, z double")
    points, triangles = mesh_frames(spark, v * 7.0, t)
    rows = weights.barycentric_weights(targets, points, triangles).toPandas()
    assert set(rows.target_vertex) == set(range(len(p))) and (rows.weight > 0).all()
    corners = {frozenset(x) for x in t}
    for i, mine in rows.groupby("target_vertex"):
        assert math.isclose(mine.weight.sum(), 1, abs_tol=1e-12) and len(mine) == len(set(mine.source_vertex)) <= 3
        assert any(set(mine.source_vertex) <= c for c in corners)
        at = (mine.weight.to_numpy()[:, None] * v[mine.source_vertex]).sum(0)
        assert np.allclose(at / np.linalg.norm(at), p[i] / np.linalg.norm(p[i]), atol=1e-9)
    assert rows[rows.target_vertex == 405].source_vertex.tolist() == [5] and (rows.target_vertex == 420).sum() == 2


def test_weights_of_triangles_of_very_different_sizes(spark):
    v = np.array([[0, 0, 0], [1000, 0, 0], [0, 1000, 0], [2000, 2000, 5], [2000.001, 2000, 5], [2000, 2000.001, 5]])
    points, triangles = mesh_frames(spark, v, [(0, 1, 2), (3, 4, 5), (0, 0, 1)])
    targets = spark.createDataFrame([(1, 250.0, 250.0, 99.0), (2, 2000.0002, 2000.0002, 0.0), (3, -1.0, 0.0, 0.0)], "target long, x double, y double, z double")
    got = {(x["target_vertex"], x["source_vertex"]): x["weight"] for x in weights.barycentric_weights(targets, points, triangles, flat=True).collect()}
    assert got == {(1, 0): pytest.approx(0.5), (1, 1): pytest.approx(0.25), (1, 2): pytest.approx(0.25), (2, 3): pytest.approx(0.6, abs=1e-4), (2, 4): pytest.approx(0.2, abs=1e-4), (2, 5): pytest.approx(0.2, abs=1e-4)}


def test_adaptive_weights_between_spheres(spark):
    fine, coarse = sphere(4), sphere(1)
    a, b = mesh_frames(spark, *fine), mesh_frames(spark, *coarse)
    down, up = weights.adaptive_weights(a, b).toPandas(), weights.adaptive_weights(b, a).toPandas()
    for rows, n in ((down, len(coarse[0])), (up, len(fine[0]))):
        assert np.allclose(rows.groupby("target_vertex").weight.sum(), 1) and rows.target_vertex.nunique() == n
    assert set(down.source_vertex) == set(range(len(fine[0])))  # every source counts when the target is coarser
    areas = weights.vertex_areas(*a).toPandas()
    assert math.isclose(areas.area.sum(), 4 * math.pi, rel_tol=0.02)
    x = np.array([fine[0][int(s)] for s in down.source_vertex])
    means = {t: (down.weight.to_numpy()[m][:, None] * x[m]).sum(0) for t in down.target_vertex.unique() for m in [(down.target_vertex == t).to_numpy()]}
    assert all(np.dot(means[t], coarse[0][int(t)]) / np.linalg.norm(means[t]) > 0.999 for t in means)


def dijkstra(n, edges, start):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, a = heapq.heappop(heap)
        for b, w in near.get(a, []) if d <= best[a] else []:
            if d + w < best.get(b, math.inf):
                best[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize("cube, at_once", [(4, 256), (1, 3)])
def test_distances_along_a_folded_sheet(spark, monkeypatch, cube, at_once):
    monkeypatch.setattr(geodesic, "CUBE", cube)
    monkeypatch.setattr(geodesic, "AT_ONCE", at_once)
    r = np.random.default_rng(8)
    wide, long = 9, 24
    fold = lambda i: (i, 0.0) if i < 12 else (23.4 - i, 0.6)  # noqa: E731  the far half lies closely over the near one
    v = np.array([[fold(i)[0], float(j), fold(i)[1]] for i in range(long) for j in range(wide)]) + r.normal(size=(wide * long, 3)) * 0.05 - 5
    t = [x for i in range(long - 1) for j in range(wide - 1) for a in [i * wide + j] for x in ((a, a + 1, a + wide), (a + 1, a + wide + 1, a + wide))]
    points, triangles = mesh_frames(spark, v, t)
    lone = spark.createDataFrame([(9999, 0.0, 0.0, 0.0), (9998, None, 1.0, 1.0)], points.schema)
    edge = mesh.edges(triangles, [])
    got = {(x["a"], x["b"]): x["distance"] for x in geodesic.distances(points.unionByName(lone), edge, [], 2.7).collect()}
    pairs = [(x["a"], x["b"]) for x in edge.collect()]
    edges = [(a, b, float(np.linalg.norm(v[a] - v[b]))) for a, b in pairs]
    want = {(a, b): d for a in range(len(v)) for b, d in dijkstra(len(v), edges, a).items() if d <= 2.7} | {(9999, 9999): 0.0, (9998, 9998): 0.0}
    assert got.keys() == want.keys() and all(math.isclose(d, want[k], abs_tol=1e-9) for k, d in got.items())
    # one bank is 1, the other 0: along the surface they stay apart
    values = spark.createDataFrame([(i, 1.0 if i // wide >= 12 else 0.0) for i in range(len(v))], "vertex long, value double")
    smooth = {x["vertex"]: x["value"] for x in mesh.smooth_along(values, points, edge, [], 0.9, 2.7).collect()}
    assert all(smooth[i] == (1.0 if i // wide >= 15 else 0.0) for i in range(len(v)) if i // wide < 9 or i // wide >= 15)


def test_distances_by_surface(spark):
    rows = [(s, i, float(i) * (1 if s == "a" else 2), 0.0, 0.0) for s in "ab" for i in range(6)]
    points = spark.createDataFrame(rows, "s string, vertex int, x double, y double, z double")
    edge = spark.createDataFrame([(s, i, j) for s in "ab" for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "s string, a int, b int")
    got = sorted((x["s"], x["a"], x["b"], x["distance"]) for x in geodesic.distances(points, edge, ["s"], 2.0).collect())
    assert got == sorted([("a", i, j, float(abs(i - j))) for i in range(6) for j in range(6) if abs(i - j) <= 2] + [("b", i, j, 2.0 * abs(i - j)) for i in range(6) for j in range(6) if abs(i - j) <= 1])
