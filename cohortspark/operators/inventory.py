"""Completeness accounting: expected against present, rollups and reports of what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def expected_grid(subjects: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every subject with every pattern. Patterns are a configuration table of a few dozen rows, so the product is as long
    as the inventory it is compared with; a pattern table above the bound is refused rather than broadcast."""
    if patterns.count() > 10_000:
        raise ValueError("patterns are configuration: at most 10000 rows")
    return subjects.crossJoin(F.broadcast(patterns))


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def presence(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """expected with a boolean column `present`."""
    return expected.join(present.select(*on).distinct().withColumn("_p", F.lit(True)), on, "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def first_missing(rows: DataFrame, subject: list[str], order: list[str], k: int = 10) -> DataFrame:
    """The first k missing entries of each subject and how many more there are."""
    by = W.partitionBy(*subject)
    return rows.withColumn("rank", F.row_number().over(by.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(by) - k, F.lit(0))).where(F.col("rank") <= k)


def in_all(subjects: DataFrame, roots: list[DataFrame], on: list[str]) -> DataFrame:
    """Subjects that every root has."""
    return reduce(lambda s, r: s.join(r.select(*on).distinct(), on, "left_semi"), roots, subjects)


def availability(grid: DataFrame, feature: str, structure: str, subject: str) -> DataFrame:
    """Subjects with data and their share, for each feature, feature and structure, and structure."""
    total = grid.agg(F.count_distinct(subject).alias("total"))
    counts = grid.groupingSets([[F.col(feature)], [F.col(feature), F.col(structure)], [F.col(structure)]], feature, structure).agg(F.count_distinct(F.when(F.col("present"), F.col(subject))).alias("n"))
    return counts.crossJoin(total).select(feature, structure, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # total is one row


def completeness(grid: DataFrame, subject: list[str], feature: str) -> DataFrame:
    """(subject, n_missing, missing_features): features with something missing, sorted and comma-joined."""
    gone = ~F.col("present")
    return grid.groupBy(*subject).agg(F.count_if(gone).alias("n_missing"), F.array_join(F.array_sort(F.collect_set(F.when(gone, F.col(feature)))), ",").alias("missing_features"))


def validation(grid: DataFrame, subject: list[str], feature: str, structure: str) -> DataFrame:
    """(subject, feature, valid_any, valid_all): a structure is valid if nothing of it is missing; a feature if any (or
    all) of its structures are."""
    by_structure = grid.groupBy(*subject, feature, structure).agg(F.bool_and("present").alias("ok"))
    return by_structure.groupBy(*subject, feature).agg(F.bool_or("ok").alias("valid_any"), F.bool_and("ok").alias("valid_all"))


def validation_summary(grid: DataFrame, subject: list[str], error_below: float = 0.0, warn_below: float = 25.0) -> DataFrame:
    """One row: subjects, complete ones, files expected and present, percentages and a verdict."""
    each = grid.groupBy(*subject).agg(F.count("*").alias("files"), F.count_if("present").alias("found"))
    totals = each.agg(F.count("*").alias("subjects"), F.count_if(F.col("found") == F.col("files")).alias("complete"), F.sum("files").alias("files"), F.sum("found").alias("found"))
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    out = totals.withColumn("complete_percent", share("complete", "subjects")).withColumn("found_percent", share("found", "files"))
    verdict = F.when((F.col("complete") == 0) | (F.col("complete_percent") < error_below), "error").when(F.col("complete_percent") < warn_below, "warning").otherwise("ok")
    return out.withColumn("verdict", verdict)


def same_features(a: DataFrame, b: DataFrame, feature: str) -> DataFrame:
    """Features that only one of two cohorts has; empty if the sets are equal."""
    x, y = a.select(feature).distinct(), b.select(feature).distinct()
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))


def feature_matrix(grid: DataFrame, feature: str, structure: str, structures: list[str]) -> DataFrame:
    """A row for each feature, a boolean for each structure."""
    wide = grid.groupBy(feature).pivot(structure, structures).agg(F.bool_or("present"))
    return wide.select(feature, *[F.coalesce(F.col(s), F.lit(False)).alias(s) for s in structures])


def layout_version(files: DataFrame, order: str, version: Column) -> DataFrame:
    """The layout of the first subject, in order, that has files of a known layout; 1 if there is none."""
    seen = files.withColumn("version", version).where("version is not null")
    return seen.agg(F.coalesce(F.min_by("version", F.struct(order, "version")), F.lit(1)).alias("version"))


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first): distinct keys with the place of their first occurrence."""
    return rows.groupBy(*keys).agg(F.min(order).alias("first"))


def run_status(status: DataFrame, subject: str) -> DataFrame:
    """(status, n, first): counts, and the smallest subject of each status."""
    return status.groupBy("status").agg(F.count("*").alias("n"), F.min(subject).alias("first"))


def failed(status: DataFrame, subject: list[str], reason: str) -> DataFrame:
    """(subject, reasons): the subjects of a run with a failed step and their reasons, sorted and comma-joined; a table, as long as it
    may be."""
    return status.where("status = 'failed'").groupBy(*subject).agg(F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"))


def combinations(scores: DataFrame, analyses: list[str], features: DataFrame, feature: str) -> DataFrame:
    """(analysis, feature) pairs with scores in at least one structure."""
    grid = features.select(feature).distinct().select(feature, F.explode(F.array(*[F.lit(a) for a in analyses])).alias("analysis"))
    return grid.join(scores.select("analysis", feature).distinct(), ["analysis", feature], "left_semi")
