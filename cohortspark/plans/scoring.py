"""Scoring a cohort: all features, structures, sides and analyses in one plan.

A measurement table carries its map keys as columns, so the grid of maps is the data itself: there is no loop over features,
hemispheres or patients. Controls are aggregated to a model once and patients are joined with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import inventory, normative

METHODS, ANALYSES = ("zscore", "wscore"), ("regional", "asymmetry")
MAP_KEYS = ["structure", "feature", "hemi", "resolution", "label"]


def score_cohort(measurements: DataFrame, demographics: DataFrame | None, *, method: str = "zscore", analyses: tuple[str, ...] = ANALYSES, covariates: list[str] | None = None, keys: list[str] = MAP_KEYS, point: str = "vertex", subject: list[str] = ["participant_id"], regions: bool = False) -> DataFrame:  # noqa: B006
    """(subject, keys, point, method, analysis, score) of all patients from a long table with a `cohort` column.

    A z-score averages depths after scoring, a W-score before. Asymmetry maps have hemi L. Subjects without
    demographics drop out of W-scores; patients_without_demographics() lists them."""
    if method not in METHODS or any(a not in ANALYSES for a in analyses):
        raise ValueError(f"method is one of {METHODS}, analyses are of {ANALYSES}")
    if method == "wscore" and (demographics is None or not covariates):
        raise ValueError("W-scores need demographics and covariates")
    depth = "depth" if "depth" in measurements.columns else None
    frame = measurements
    if method == "wscore" and depth:
        frame = normative.depth_mean(frame, [*subject, "cohort", *keys, point])
        depth = None
    points = [*keys, point]
    out = None
    for analysis in analyses:
        maps = frame
        if analysis == "asymmetry":
            rest = [k for k in keys if k != "hemi"]
            if regions:
                maps = normative.asymmetry_regions(frame, [*subject, "cohort", *keys], region=point)
            else:
                maps = normative.asymmetry_maps(frame, [*subject, "cohort", *rest, point, *([depth] if depth else [])]).withColumn("hemi", F.lit("L"))
        controls, patients = maps.where("cohort = 'control'"), maps.where("cohort = 'patient'")
        if method == "zscore":
            scores = normative.zscore(controls, patients, points, depth=depth, subject=subject, min_controls=1 if regions else 2)
        else:
            with_demo = lambda d: d.join(demographics.select(*subject, *covariates), subject)  # noqa: E731, B023
            scores = normative.wscore(with_demo(controls), with_demo(patients), points, covariates, subject=subject, regions=regions)
        scores = scores.select(*subject, *points, F.lit(method).alias("method"), F.lit(analysis).alias("analysis"), "score")
        out = scores if out is None else out.unionByName(scores)
    return out


def patients_without_demographics(measurements: DataFrame, demographics: DataFrame, subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    return measurements.where("cohort = 'patient'").select(*subject).distinct().join(demographics, subject, "left_anti")


def run_pipeline(measurements: DataFrame, demographics: DataFrame, expected: DataFrame, *, covariates: list[str], method: str = "wscore", keys: list[str] = MAP_KEYS, subject: list[str] = ["participant_id"], on: list[str] | None = None, error_below: float = 0.0, derive: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:  # noqa: B006
    """Validate, score and summarise: a dict of lazy frames `validation`, `missing`, `scores` and `summary`.

    `expected` has the map keys each subject should have. The only action is the validation verdict, one row. Where no
    subject is complete, or fewer than error_below percent are, `derive` gets the missing rows of `expected` and returns
    their measurements, and the whole is validated again; the run stops if it is still not complete enough."""
    on = on or [*subject, *[k for k in keys if k in expected.columns]]
    grid = inventory.presence(expected, measurements, on)
    verdict = inventory.validation_summary(grid, subject, error_below)
    row = verdict.first()
    if row["verdict"] == "error" and derive is not None:
        measurements = measurements.unionByName(derive(inventory.missing(expected, measurements, on)))
        grid = inventory.presence(expected, measurements, on)
        verdict = inventory.validation_summary(grid, subject, error_below)
        row = verdict.first()
    if row["verdict"] == "error":
        raise ValueError(f"{row['complete']} of {row['subjects']} subjects are complete")
    scores = score_cohort(measurements, demographics, method=method, covariates=covariates, keys=keys, subject=subject)
    summary = normative.score_summary(scores, [*subject, *keys, "method", "analysis"])
    return {"validation": verdict, "missing": inventory.first_missing(grid.where(~F.col("present")), subject, on), "scores": scores, "summary": summary}
