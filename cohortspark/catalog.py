"""Registered queries and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.queries import audit, files, plans, scores, space

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = scores.QUERIES | audit.QUERIES | space.QUERIES | plans.QUERIES | files.QUERIES
ORACLES: dict[str, str] = scores.ORACLES | audit.ORACLES | space.ORACLES | plans.ORACLES | files.ORACLES
