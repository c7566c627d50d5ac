"""Joins on keys that many rows share: the same rows with and without hot keys, and one plain join where rows are few."""

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import common


def sides(spark, n):
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 400).cast("long").alias("k"), F.col("id").alias("x"))
    right = left.where("k is not null and k % 5 <> 4").groupBy("k").agg(F.count("*").alias("w")).withColumn("y", F.col("k") * 2)
    return left, right


@pytest.mark.parametrize("n", [common.FEW - 1, common.FEW + 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_are_those_of_a_join(spark, n, how):
    left, right = sides(spark, n)
    got = common.join_hot(left, right, "k", "w", n, how)
    want = left.join(right.drop("w"), "k", how)
    cells = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    assert got.columns == want.columns and cells(got) == cells(want)


def test_few_rows_take_one_join(spark):
    """Every small join was two, with two broadcasts: rounds of them filled the driver's memory with plans and threads."""
    left, right = sides(spark, 1000)
    joins = lambda total: common.join_hot(left, right, "k", "w", total)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(common.FEW) == 1 and joins(common.FEW + 1) == 3
