"""Plans and steps of the mesh queries that must hold on large meshes."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortspark import catalog, fixtures
from cohortspark.operators import mesh

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_sampled_profile_broadcasts_no_mesh(spark):
    """Tables of a mesh's size were broadcast, as their files are small."""
    assert "BroadcastExchange" not in plan(catalog.QUERIES["depth_profile_sampled"](spark, FOLDER))


def test_profile_is_its_pieces(spark):
    """One window gives what gradients and signed depths give apart: gaps, layers beyond the slots, nulls and single layers too."""
    rows = [("a", i, float(i * i), float(i % 3), 0.5, float(i)) for i in (0, 1, 2, 4, 5, 6, 7, 9, 11, 12, 14)]
    rows += [("b", i, 1.0, 1.0, float(i // 2), 2.0 * i) for i in range(5)]  # twice in one place
    rows += [("c", 3, 1.0, 1.0, 1.0, 1.0), ("d", 0, 1.0, 1.0, 1.0, None), ("d", 1, 2.0, 1.0, None, 3.0), ("d", 2, 2.0, 1.0, 1.0, 3.0), ("d", 3, 2.0, 3.0, 1.0, None)]
    rows += [("e", i, float("nan") if i == 2 else float(i), 0.0, 0.0, float(i)) for i in range(4)]
    layers = spark.createDataFrame(rows, "v string, layer int, x double, y double, z double, value double")
    steps = mesh.layer_gradient(layers, ["v"])
    want = layers.select("v", F.lit("raw").alias("kind"), F.col("layer").alias("slot"), "value")
    for kind in ("distance", "gradient"):
        want = want.unionByName(steps.select("v", F.lit(kind).alias("kind"), F.col("layer").alias("slot"), F.col(kind).alias("value")))
    depth = mesh.signed_depth(steps.select("v", (F.col("layer") - 1).alias("e"), "distance"), ["v"])
    want = want.unionByName(depth.select("v", F.lit("depth").alias("kind"), "slot", F.col("depth").alias("value")))
    cells = lambda frame: sorted((r["v"], r["kind"], r["slot"], "none" if r["value"] is None else "nan" if math.isnan(r["value"]) else repr(r["value"] + 0.0)) for r in frame.collect())
    got = mesh.depth_profile(layers, ["v"])
    assert cells(got) == cells(want)
    assert plan(mesh.depth_profile(layers, ["v"])).count("Exchange hashpartitioning") == 1


def test_layer_means_in_any_order(spark, tmp_path):
    """Means whose seventh decimal is a 5, from 32 rows: floating-point sums rounded them up or down by the order of rows."""
    cents = [5000000 + (i * 7919 + j * 104729) % 4999999 for j in range(40) for i in range(32)]
    cents[::32] = [c + 1 - sum(cents[32 * j : 32 * j + 32]) % 2 for j, c in enumerate(cents[::32])]  # odd sums: the sixth decimal's ties
    lines = [(j, 8 * i, 1, float(1 + i % 50), (i % 11) / 100, (i % 9) / 100, cents[32 * j + i] / 100) for j in range(40) for i in range(32)]
    schema = "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    want = {j: sum(cents[32 * j : 32 * j + 32]) / 3200 for j in range(40)}
    for k, rows in enumerate((lines, lines[::-1])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = {r["subject_id"]: r["value"] for r in fixtures.layers(spark, f"{tmp_path}/{k}").collect()}
        assert got == want


def against_sql(spark, folder, name, rows):
    """Rows of a query and of its SQL over these order lines."""
    schema = "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    result = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    mine = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    cells = lambda rows: sorted(tuple("none" if x is None else x if isinstance(x, str) else repr(float(x) + 0.0) for x in row) for row in rows)
    return cells(mine), cells(result.fetchall())


#: Values with three and four decimals, as means of hundredths are none; a layer of hundredths among them.
FINER = [(1, 8 * i, n, 1.0 + i + n, 0.001 * (i + n), 0.0625, 100.125 * (i + 1) + 0.001 * n) for i in range(5) for n in (1, 2, 3, 5, 6, 7)] + [(1, 8, 4, 5.0, 0.03, 0.06, 200.55)]


def test_profile_of_values_finer_than_hundredths(spark, tmp_path):
    """They were rounded to hundredths before they were added up."""
    mine, theirs = against_sql(spark, tmp_path, "depth_profile", FINER)
    assert mine == theirs


def test_profile_of_rows_without_keys(spark, tmp_path):
    """As in the SQL, null keys have no depths, and a layer without a number comes last."""
    rows = [(*key, n, float(n * n), 0.01 * n, 0.02, 10.0 * n) for key in ((None, 0), (2, None)) for n in range(1, 8)]
    rows += [(3, 0, n, 5.0 * (n or 9), 0.01 * (n or 3), 0.02, 10.0 * (n or 4)) for n in (1, 2, 3, None, 7)]
    mine, theirs = against_sql(spark, tmp_path, "depth_profile", rows)
    assert mine == theirs


def test_gradient_of_values_finer_than_hundredths(spark, tmp_path):
    mine, theirs = against_sql(spark, tmp_path, "layer_gradient", FINER)
    assert mine == theirs


def test_gradient_of_a_layer_without_a_number(spark, tmp_path):
    """It came first, so that layer 0 had a distance."""
    rows = [(3, 0, n, 5.0 * (n or 9), 0.01 * (n or 3), 0.02, 10.0 * (n or 4)) for n in (1, 2, 3, None, 7)]
    mine, theirs = against_sql(spark, tmp_path, "layer_gradient", rows)
    assert mine == theirs


@needs_tables
def test_bricks_are_not_broadcast(spark):
    for name in ("process_hippocampus", "process_cohort"):
        joins = [line for line in plan(catalog.QUERIES[name](spark, FOLDER)).splitlines() if "Join" in line and "bk#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)


def test_edges_are_spread_before_they_are_distinct(spark):
    """One task that read many triangles gathered all of their edges."""
    text = plan(mesh.edges(spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "v0 int, v1 int, v2 int"), []))
    assert text.index("Exchange hashpartitioning") > text.rindex("HashAggregate")
