"""Scores against plain numpy, and the edge cases of the score definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.scores import asymmetry, attenuate, float_divide, region_asymmetry
from cohortspark.operators import gram, normative, series
from cohortspark.plans import scoring
from cohortspark.streaming import scores as streaming


def long(spark, matrix, cohort, extra=None):
    rows = [(i, cohort, v, float(matrix[i, v]), *((float(x) for x in extra[i]) if extra is not None else ())) for i in range(len(matrix)) for v in range(matrix.shape[1])]
    names = ["participant_id", "cohort", "vertex", "value", *(f"x{k}" for k in range(0 if extra is None else extra.shape[1]))]
    return spark.createDataFrame(rows, names)


def grid(frame, column="score"):
    return {(r["participant_id"], r["vertex"]): r[column] for r in frame.collect()}


@pytest.mark.parametrize("p", [1, 2, 3])
def test_wscore_is_least_squares(spark, p):
    rng = np.random.default_rng(p)
    x, y, xp, yp = rng.normal(size=(30, p)), rng.normal(size=(30, 4)), rng.normal(size=(3, p)), rng.normal(size=(3, 4))
    y += x[:, :1] * 2
    got = grid(normative.wscore(long(spark, y, "control", x), long(spark, yp, "patient", xp), ["vertex"], [f"x{k}" for k in range(p)]))
    design = np.column_stack([np.ones(30), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    sd = (y - design @ beta).std(0)
    want = (yp - np.column_stack([np.ones(3), xp]) @ beta) / sd
    assert all(math.isclose(got[i, v], want[i, v], rel_tol=1e-8) for i in range(3) for v in range(4))


def test_constant_covariate_takes_minimum_norm_fit(spark):
    rng = np.random.default_rng(0)
    x, y = np.column_stack([np.full(12, 3.0), rng.normal(size=12)]), rng.normal(size=(12, 2))
    got = grid(normative.wscore(long(spark, y, "control", x), long(spark, y[:2], "patient", x[:2]), ["vertex"], ["x0", "x1"]))
    design = np.column_stack([np.ones(12), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    want = (y[:2] - design[:2] @ beta) / (y - design @ beta).std(0)
    assert all(math.isclose(got[i, v], want[i, v], rel_tol=1e-6) for i in range(2) for v in range(2))


def test_zero_points_and_incomplete_cases(spark):
    y = np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 4.0], [0.0, 100.0]])
    x = np.array([[1.0], [2.0], [3.0], [np.nan]])
    patient = np.array([[5.0, 3.0]])
    maps = grid(normative.wscore(long(spark, y, "control", x), long(spark, patient, "patient", np.array([[2.0]])), ["vertex"], ["x0"]))
    regions = grid(normative.wscore(long(spark, y, "control", x), long(spark, patient, "patient", np.array([[2.0]])), ["vertex"], ["x0"], regions=True))
    assert maps[0, 0] == 5.0 and regions[0, 0] == 0.0
    slope, intercept = np.polyfit([1, 2, 3], [1, 2, 4], 1)
    sd = (np.array([1, 2, 4]) - intercept - slope * np.array([1, 2, 3])).std()
    assert math.isclose(maps[0, 1], (3 - intercept - 2 * slope) / sd, rel_tol=1e-9)


def test_exact_fit_divides_by_zero_in_maps_only(spark):
    y, x = np.array([[1.0], [2.0], [3.0]]), np.array([[1.0], [2.0], [3.0]])
    patient, px = np.array([[9.0]]), np.array([[2.0]])
    assert abs(grid(normative.wscore(long(spark, y, "control", x), long(spark, patient, "patient", px), ["vertex"], ["x0"]))[0, 0]) > 1e6
    assert math.isfinite(grid(normative.wscore(long(spark, y, "control", x), long(spark, patient, "patient", px), ["vertex"], ["x0"], regions=True))[0, 0])


def test_zscore_edges(spark):
    y = np.array([[1.0, 5.0], [3.0, 5.0]])
    got = grid(normative.zscore(long(spark, y, "control"), long(spark, np.array([[4.0, 6.0]]), "patient"), ["vertex"]))
    assert got == {(0, 0): 2.0, (0, 1): 1.0}
    one = long(spark, y[:1], "control")
    assert normative.zscore(one, long(spark, y, "patient"), ["vertex"]).count() == 0
    assert normative.zscore(one, long(spark, y, "patient"), ["vertex"], min_controls=1).count() == 4
    assert normative.zscore(one.limit(0), long(spark, y, "patient"), ["vertex"]).count() == 0


def test_nan_controls_are_skipped_by_the_nan_aware_score_only(spark):
    y = np.array([[1.0], [3.0], [np.nan]])
    controls, patients = (long(spark, m, c).withColumn("depth", F.lit(0)) for m, c in ((y, "control"), (np.array([[5.0]]), "patient")))
    assert grid(normative.zscore_nan(controls, patients, ["vertex"], depth="depth"))[0, 0] == 3.0
    assert math.isnan(grid(normative.zscore(controls, patients, ["vertex"]))[0, 0])


def test_controls_score_zero_mean_unit_deviation(spark):
    y = np.random.default_rng(3).normal(5, 2, (25, 3))
    scores = normative.zscore(long(spark, y, "control"), long(spark, y, "patient"), ["vertex"])
    for r in scores.groupBy("vertex").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect():
        assert abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9


@pytest.mark.parametrize("f", [2, 3])
def test_mahalanobis(spark, f):
    rng = np.random.default_rng(f)
    y, p = rng.normal(size=(20, f)), rng.normal(size=(4, f))
    wide = lambda m: spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(m)], ["participant_id", "vertex", *(f"f{k}" for k in range(f))])
    got = {r["participant_id"]: r["distance"] for r in normative.mahalanobis(wide(y), wide(p), ["vertex"], [f"f{k}" for k in range(f)]).collect()}
    d = p - y.mean(0)
    want = np.sqrt(np.einsum("ni,ij,nj->n", d, np.linalg.pinv(np.cov(y.T)), d))
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in range(4))


def test_asymmetry_definitions(spark):
    rows = spark.createDataFrame([(3.0, 1.0), (-3.0, 1.0), (0.0, 0.0), (float("nan"), 1.0)], ["l", "r"])
    got = [tuple(r) for r in rows.select(asymmetry(F.col("l"), F.col("r")), region_asymmetry(F.col("l"), F.col("r"))).collect()]
    assert got[:3] == [(1.0, 1.0), (-1.0, 0.0), (0.0, 0.0)] and math.isnan(got[3][0])
    one = spark.createDataFrame([(1.0, 2.0, 0.5), (-1.0, 0.0, 3.0)], "a double, b double, s double")
    assert [r[0] for r in one.select(float_divide(F.col("a"), F.col("b"))).collect()] == [0.5, float("-inf")]
    assert [r[0] for r in one.select(attenuate(F.col("s"))).collect()] == [0.15, 3.0]


def test_missing_hemisphere_has_no_asymmetry(spark):
    rows = spark.createDataFrame([(1, "L", 0, 2.0), (1, "R", 0, 1.0), (2, "L", 0, 2.0)], ["participant_id", "hemi", "vertex", "value"])
    assert [r["participant_id"] for r in normative.asymmetry_maps(rows, ["participant_id", "vertex"]).collect()] == [1]


def test_series_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=40), "b": np.zeros(20), "c": np.array([2.0]), "d": rng.normal(size=33).cumsum()}
    rows = spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)], ["series_id", "t", "value"])
    got = {r["series_id"]: r for r in series.features(rows, ["series_id"]).collect()}
    packed = {r["series_id"]: r for r in series.packed_features(spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], ["series_id", "values"]), ["series_id"]).collect()}
    for k, x in data.items():
        n = len(x)
        c = np.array([(x[: n - j] * x[j:]).sum() for j in range(n)])
        c = c / c[0] if c[0] else c
        stop = np.flatnonzero(c[1:] < 0)
        want = 0.65 * c[1 : 1 + (stop[0] if len(stop) else n - 1)].sum()
        t = np.arange(n)
        flat = x - np.polyval(np.polyfit(t, x, 1), t) if n > 1 else x * 0
        a, f = np.abs(np.fft.rfft(flat)), np.arange(n // 2 + 1) / (n * 0.65)
        for g in (got[k], packed[k]):
            assert math.isclose(g["timescale"], want, abs_tol=1e-8)
            assert math.isclose(g["alff"], a[(f >= 0.01) & (f <= 0.08)].sum(), abs_tol=1e-6)
            if n > 1:
                assert math.isclose(g["rmssd"], np.sqrt((np.diff(x) ** 2).sum()) / (n - 1), abs_tol=1e-9)
            else:
                assert math.isnan(g["rmssd"])
    assert math.isnan(got["b"]["falff"])


def test_score_cohort_and_pipeline(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "control" if i < 8 else "patient", "cortex", "thickness", h, "32k", "white", v, float(rng.normal(3))) for i in range(11) for h in "LR" for v in range(3)]
    frame = spark.createDataFrame(rows, "participant_id long, cohort string, structure string, feature string, hemi string, resolution string, label string, vertex int, value double")
    demo = spark.createDataFrame([(i, float(i % 5)) for i in range(10)], "participant_id long, age double")
    z = scoring.score_cohort(frame, None, method="zscore")
    assert z.groupBy("analysis").count().orderBy("analysis").collect() == [("asymmetry", 9), ("regional", 18)]
    w = scoring.score_cohort(frame, demo, method="wscore", covariates=["age"])
    assert w.select("participant_id").distinct().count() == 2
    assert [r[0] for r in scoring.patients_without_demographics(frame, demo).collect()] == [10]
    expected = frame.select("participant_id", "hemi").distinct()
    out = scoring.run_pipeline(frame, demo, expected, covariates=["age"])
    assert out["missing"].count() == 0 and out["validation"].first()["verdict"] == "ok" and out["summary"].count() > 0
    with pytest.raises(ValueError):
        scoring.run_pipeline(frame, demo, expected.withColumn("hemi", F.lit("X")), covariates=["age"])
    with pytest.raises(ValueError):
        scoring.score_cohort(frame, None, method="median")


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    y = np.random.default_rng(1).normal(size=(6, 2))
    controls, patients = long(spark, y[:4], "control"), long(spark, y[4:], "patient")
    patients.write.parquet(str(tmp_path / "in"))
    model = normative.zscore_model(controls, ["vertex"])
    stream = spark.readStream.schema(patients.schema).parquet(str(tmp_path / "in"))
    streaming.write_stream(streaming.score_stream(stream, model, ["vertex"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert grid(spark.read.parquet(str(tmp_path / "out"))) == grid(normative.zscore(controls, patients, ["vertex"]))


def test_many_features_as_packed_matrices(spark):
    r = np.random.default_rng(11)
    f, points, people = 60, 3, 150
    y = r.normal(size=(points, people, f)) @ r.normal(size=(f, f)) * np.geomspace(1, 1e4, f) + 50
    y[2, :, 5] = y[2, :, 4]  # singular
    names = [f"f{k}" for k in range(f)]
    rows = [(i, v, *map(float, y[v, i])) for v in range(points) for i in range(people)] + [(900, 0, *[None] * f), (901, 7, *[1.0] * f)]
    frame = spark.createDataFrame(rows, ["participant_id", "vertex", *names]).repartition(3)
    controls, patients = frame.where("participant_id < 120 or participant_id >= 900"), frame.where("participant_id >= 120 and participant_id < 900")
    out = normative.mahalanobis(controls, patients, ["vertex"], names)
    got = {(x["participant_id"], x["vertex"]): x["distance"] for x in out.collect()}
    assert len(got) == points * 30
    for v in range(points):
        c, d = y[v, :120], y[v, 120:] - y[v, :120].mean(0)
        s = np.cov(c.T)
        want = np.sqrt(np.einsum("ni,ij,nj->n", d, np.linalg.pinv(s, hermitian=True) if v == 2 else np.linalg.inv(s), d))
        assert np.allclose([got[120 + i, v] for i in range(30)], want, rtol=1e-5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "covar" not in plan and plan.count("FlatMapGroupsInArrow") == 1 and plan.count("FlatMapCoGroupsInArrow") == 1
    # the moments by themselves, from parts of one row and of many
    for parts in (1, 40):
        m = {x["vertex"]: x for x in gram.moments(frame.where("participant_id < 900").repartition(parts), ["vertex"], names[:4]).collect()}
        for v in range(points):
            assert m[v]["n"] == people and np.allclose(m[v]["mean"], y[v, :, :4].mean(0))
            assert np.allclose(gram.unpacked(np.array(m[v]["scatter"])[None], 4)[0], np.cov(y[v, :, :4].T) * (people - 1))


def test_wscore_of_many_covariates(spark):
    r = np.random.default_rng(12)
    p, people = 10, 60
    x = r.normal(size=(people, p)) * np.geomspace(1, 1e3, p) + 10
    value = x @ r.normal(size=p) + r.normal(size=people)
    names = [f"c{k}" for k in range(p)]
    rows = [(i, v, float(value[i]) if v else 0.0, *map(float, x[i])) for v in (0, 1) for i in range(people)]
    frame = spark.createDataFrame(rows, ["participant_id", "vertex", "value", *names])
    model = {m["vertex"]: m for m in normative.wscore_model(frame.where("participant_id < 50"), ["vertex"], names).collect()}
    a = np.column_stack([np.ones(50), x[:50]])
    beta = np.linalg.lstsq(a, value[:50], rcond=None)[0]
    assert np.allclose(model[1]["coefficients"], beta, rtol=1e-6) and math.isclose(model[1]["resid_std"], np.std(value[:50] - a @ beta), rel_tol=1e-8)
    assert model[0]["zero"] and not model[1]["zero"] and model[1]["n"] == 50
