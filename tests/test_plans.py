"""Derived features, stacked distances, reports and re-validation on small hand-made cohorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import inventory, normative
from cohortspark.plans import deriving, report, scoring
from cohortspark.sources import demographics as D


def test_run_derives_what_is_missing_and_validates_again(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "control" if i < 6 else "patient", h, v, float(rng.normal(3))) for i in range(8) for h in "LR" for v in range(3)]
    frame = spark.createDataFrame(rows, "participant_id long, cohort string, hemi string, vertex int, value double")
    expected = frame.select("participant_id", "hemi").distinct()
    half, kept = frame.where("hemi = 'L'"), {"keys": ["hemi"], "method": "zscore", "covariates": []}
    with pytest.raises(ValueError):
        scoring.run_pipeline(half, None, expected, **kept)
    asked = []

    def derive(missing):
        asked.append(missing.count())
        return frame.join(missing, ["participant_id", "hemi"], "left_semi").select(*frame.columns)

    out = scoring.run_pipeline(half, None, expected, derive=derive, **kept)
    assert asked == [8] and out["missing"].count() == 0
    assert out["scores"].count() == scoring.score_cohort(frame, None, keys=["hemi"]).count()
    with pytest.raises(ValueError):  # still incomplete after deriving
        scoring.run_pipeline(half, None, expected, derive=lambda missing: frame.limit(0), **kept)


def test_stacked_distances_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(14, 2, 3)) * [[1], [1000]] + 5
    rows = [(i, "control" if i < 11 else "patient", "L", 0, f, d, float(values[i, k, d])) for i in range(14) for k, f in enumerate("ab") for d in range(3) if not (i == 13 and f == "b")]
    frame = spark.createDataFrame(rows, "participant_id long, cohort string, hemi string, vertex int, feature string, depth int, value double")
    got = {r["participant_id"]: r["distance"] for r in normative.mahalanobis_maps(frame, ["hemi", "vertex"], ["a", "b"], depths=[0, 1, 2], analyses=("regional",)).collect()}
    flat = values.reshape(14, 6)
    mean, inverse = flat[:11].mean(0), np.linalg.inv(np.cov(flat[:11].T))
    want = {i: float(np.sqrt((flat[i] - mean) @ inverse @ (flat[i] - mean))) for i in (11, 12)}  # 13 lacks a feature
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert normative.mahalanobis_maps(frame, ["hemi", "vertex"], ["a", "b"], depths=[0, 1, 2]).where("analysis = 'asymmetry'").count() == 0  # no right side


def test_cortical_takes_series(spark):
    rng = np.random.default_rng(4)
    maps = spark.createDataFrame([(1, "thickness", "L", v, float(v)) for v in range(3)], "participant_id long, feature string, hemi string, vertex int, value double")
    signals = spark.createDataFrame([(1, "L", v, [float(x) for x in rng.normal(size=40)]) for v in range(3)], "participant_id long, hemi string, vertex int, values array<double>")
    points = spark.createDataFrame([(v, float(v), 0.0, 0.0) for v in range(3)], "vertex int, x double, y double, z double")
    edge = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "a int, b int")
    weights = spark.createDataFrame([(0, 0, 0.5), (2, 0, 0.5)], "source_vertex int, target_vertex int, weight double")
    got = {r["feature"]: r["value"] for r in deriving.cortical(maps, points, edge, weights, sigma=1.0, hops=1, signals=signals).collect()}
    assert set(got) == {"thickness", "rmssd", "timescales", "alff", "falff"}
    w = np.exp(-0.5)
    assert abs(got["thickness"] - (w / (1 + w) + (2 + w) / (1 + w)) / 2) < 1e-12


def test_status_lists_failed_subjects(spark):
    cortex = spark.createDataFrame([(1, "thickness", "L", 0, 1.0)], "participant_id long, feature string, hemi string, vertex int, value double")
    regions = spark.createDataFrame([(2, "volume", "Lamyg", 3.0)], "participant_id long, feature string, region string, value double")
    requested = spark.createDataFrame([(i, s, f) for i in (1, 2, 3) for s, f in (("cortex", "thickness"), ("subcortical", "volume"))], "participant_id long, structure string, feature string")
    out = deriving.process_cohort({"cortex": cortex, "subcortical": regions}, requested)
    assert {(r["structure"], r["point"]) for r in out["measurements"].collect()} == {("cortex", "0"), ("subcortical", "Lamyg")}
    failed = dict(map(tuple, inventory.failed(out["status"], ["participant_id"], "reason").collect()))
    assert failed == {1: "subcortical/volume", 2: "cortex/thickness", 3: "cortex/thickness,subcortical/volume"}


def test_own_age_bin_and_reports(spark):
    controls = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate([(20, "F"), (25, "M"), (26, "F"), (37, "M")])], "participant_id long, age int, sex string")
    patients = spark.createDataFrame([(10, 25, "F"), (11, 26, "M"), (12, 90, "F"), (13, None, "M"), (14, 12, "M")], "participant_id long, age int, sex string")
    own = {(r["participant_id"], r["bin"]) for r in D.own_age_bins(controls, patients, "age", "sex", ["participant_id"]).where("own").collect()}
    assert own == {(10, 20), (11, 25)}
    scores = spark.createDataFrame([(10, "L", "regional", "thickness", 0.5), (10, "L", "regional", "thickness", -3.0), (11, "L", "regional", "thickness", 1.0)], "participant_id long, hemi string, analysis string, feature string, score double")
    tables = report.subject_reports(scores, patients, controls, age="age", sex="sex", group=["hemi"])
    means = {r["participant_id"]: (r["mean"], r["extreme"], r["n_beyond"], r["n"]) for r in tables["means"].collect()}
    assert means[10] == pytest.approx((-1.425, -3.0, 1, 2)) and means[11] == pytest.approx((0.3, 1.0, 0, 1))
    assert tables["identity"].count() == 2 and tables["cohort"].first()["n"] == 4
    assert [tuple(r) for r in tables["combinations"].select("analysis", "feature").collect()] == [("regional", "thickness")]
