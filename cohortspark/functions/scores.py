"""Column functions of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD, ALPHA = 1.96, 0.3


def asymmetry(left: Column, right: Column) -> Column:
    """(l - r) / mean where the mean is positive; elsewhere the mean itself."""
    mean = (left + right) / 2
    return F.when(mean > 0, (left - right) / mean).otherwise(mean)


def region_asymmetry(left: Column, right: Column) -> Column:
    """As asymmetry(), but 0 where the mean is not positive."""
    mean = (left + right) / 2
    return F.when(mean > 0, (left - right) / mean).otherwise(0.0)


def attenuate(score: Column, threshold: float = THRESHOLD, alpha: float = ALPHA) -> Column:
    """Scores below the threshold in size are scaled down, not dropped."""
    return F.when(F.abs(score) < threshold, score * alpha).otherwise(score)


def float_divide(numerator: Column, denominator: Column) -> Column:
    """Division as floating-point hardware does it: x / 0 is an infinity or NaN, not an error."""
    by_zero = F.when(numerator > 0, F.lit(float("inf"))).when(numerator < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(denominator == 0, F.when(F.isnan(numerator), F.lit(float("nan"))).otherwise(by_zero)).otherwise(numerator / F.when(denominator != 0, denominator))


def no_nan(value: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def rounded(value: Column, places: int = 6) -> Column:
    """For reports and comparisons: no negative zero."""
    return F.round(value, places) + F.lit(0.0)
