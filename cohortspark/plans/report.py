"""The tables of clinical reports, for all patients at once; one patient's report is a filter on their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.scores import attenuate
from cohortspark.operators import inventory
from cohortspark.sources import demographics as D

THRESHOLD = 1.96


def subject_reports(scores: DataFrame, demographics: DataFrame, controls: DataFrame, *, age: str, sex: str, group: list[str], feature: str = "feature", subject: list[str] = ["participant_id"]) -> dict[str, DataFrame]:  # noqa: B006
    """Lazy frames `identity`, `cohort`, `ages`, `means` and `combinations`.

    identity: age and sex of the scored patients. cohort: one row on the controls. ages: the controls' histogram for each patient, the
    patient's own bin flagged. means: for each patient and group the mean attenuated score, the extreme one and how many points lie beyond
    the threshold. combinations: the analyses and features that have scores."""
    patients = scores.select(*subject).distinct()
    identity = patients.join(demographics, subject).select(*subject, age, sex)
    beyond = F.abs("score") >= THRESHOLD
    means = scores.groupBy(*subject, *group).agg(F.avg(attenuate(F.col("score"))).alias("mean"), F.max_by("score", F.abs("score")).alias("extreme"), F.count_if(beyond).alias("n_beyond"), F.count("*").alias("n"))
    tables = {"identity": identity, "cohort": D.cohort_summary(controls, age, sex), "ages": D.own_age_bins(controls, identity, age, sex, subject), "means": means}
    if {"analysis", feature} <= set(scores.columns):
        tables["combinations"] = inventory.combinations(scores, ["regional", "asymmetry"], scores, feature)
    return tables
