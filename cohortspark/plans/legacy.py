"""The older analysis as one plan: control datasets together, scores of every feature, distances over all of them.

Where the newer plan (scoring) averages depths and scores by one method, this one cuts depths at three, skips NaN controls, can take
covariates off before scoring, and ends with Mahalanobis distances over the features that every subject has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import normative
from cohortspark.sources import demographics as D
from cohortspark.sources import maps


def run_analysis(controls: list[DataFrame], patients: DataFrame, *, features: list[str], demographics: DataFrame | None = None, deconfound: list[str] | None = None, covariates: list[str] | None = None, analyses: tuple[str, ...] = ("regional", "asymmetry"), keys: list[str] = ["hemi", "vertex"], depths: list[int] | None = None, subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    """(subject, keys, feature, analysis, method, score) of all patients.

    controls are tables of measurements (subject, keys, feature, depth, value), one for each dataset, patients one more; keys
    hold every map key besides the feature, so structures, resolutions and labels need no loop. deconfound names covariates
    whose effect on the controls is taken off everyone; covariates ask for W-scores of depth means in place of z-scores; both are
    columns of demographics. Asymmetry maps have hemi L. Two or more features also give a distance, under their joint label;
    it is over the features as they are, not deconfounded."""
    columns = [*subject, *keys, "feature", "depth", "value"]
    every = D.union([c.select(*columns) for c in controls]).drop("dataset").withColumn("cohort", F.lit("control"))
    every = every.unionByName(patients.select(*columns).withColumn("cohort", F.lit("patient"))).where(F.col("feature").isin(features))
    frame = every
    if deconfound:
        known = frame.join(demographics.select(*subject, *deconfound), subject)
        frame = normative.deconfound(known, F.col("cohort") == "control", [*keys, "feature", "depth"], deconfound, subject=[*subject, "cohort"])
    points, out = [*keys, "feature"], []
    for analysis in analyses:
        some = frame
        if analysis == "asymmetry":
            rest = [k for k in points if k != "hemi"]
            some = normative.asymmetry_maps(frame, [*subject, "cohort", *rest, "depth"]).withColumn("hemi", F.lit("L"))
        split = [some.where(F.col("cohort") == c) for c in ("control", "patient")]
        if covariates:
            split = [normative.depth_mean(s, [*subject, *points]).join(demographics.select(*subject, *covariates), subject) for s in split]
            scores, method = normative.wscore(*split, points, covariates, subject=subject), "wscore"
        else:
            scores, method = normative.zscore_nan(*split, points, depth="depth", subject=subject), "zscore"
        out.append(scores.select(*subject, *points, F.lit(analysis).alias("analysis"), F.lit(method).alias("method"), "score"))
    if len(features) > 1:
        far = normative.mahalanobis_maps(every, keys, features, depths=depths, analyses=analyses, subject=subject)
        out.append(far.select(*subject, *keys, F.lit(maps.feature_label(features)).alias("feature"), "analysis", F.lit("mahalanobis").alias("method"), F.col("distance").alias("score")))
    return reduce(DataFrame.unionByName, out)
