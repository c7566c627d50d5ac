"""Demographics, inventories, meshes, grids and files: edge cases and plain reimplementations."""

import base64
import gzip
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import names
from cohortspark.operators import grid, inventory, mesh
from cohortspark.sources import demographics as D
from cohortspark.sources import maps


def one(frame):
    return [tuple(r) for r in frame.collect()]


def test_load_reads_both_separators_and_checks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,SES,AGE\n1,a,30\n2,b,40\n")
    (tmp_path / "a.tsv").write_text("ID\tSES\tAGE\n1\ta\t30\n")
    (tmp_path / "b.csv").write_text("ID,SES,AGE\n")
    assert D.load(spark, str(tmp_path / "a.csv")).columns == ["participant_id", "session_id", "AGE"]
    assert D.load(spark, str(tmp_path / "a.tsv"), schema="ID int, SES string, AGE int").first()["AGE"] == 30
    with pytest.raises(ValueError):
        D.load(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        D.load(spark, str(tmp_path / "a.csv"), {"NOPE": "participant_id"})


def test_normative_columns(spark):
    frame = spark.createDataFrame([(1, 1, 30.0, "1.5", "F"), (2, 2, 41.0, "2", "m"), (3, 3, 52.0, "x", "M")], "participant_id int, row int, age double, w string, sex string")
    out, codes = D.validated(frame, {"age": "int", "sex": "binary"}, "row")
    assert one(out.select("age", "sex").orderBy("row")) == [(30, 1), (41, 0), (52, 0)]
    again, _ = D.validated(frame.where("sex <> 'F'"), {"sex": "binary"}, "row", codes)
    assert {r["sex"] for r in again.collect()} == {0}
    assert one(D.decode(out, "sex", codes["sex"]).select("sex").orderBy("row")) == [("f",), ("m",), ("m",)]
    for bad in ({"age": "categorical"}, {"nope": "int"}, {"w": "float"}, {"participant_id": "binary"}):
        with pytest.raises(ValueError):
            D.validated(frame, bad, "row")
    with pytest.raises(ValueError):
        D.validated(frame.withColumn("age", F.col("age") + 0.5), {"age": "int"}, "row")
    with pytest.raises(ValueError):
        D.validated(frame.withColumn("age", F.when(F.col("row") > 1, F.col("age"))), {"age": "int"}, "row")


def test_columns_are_checked_in_one_job(spark, tmp_path):
    rows = [(i, str(20 + i % 50), str(i / 3), "aB"[i % 2], "Yes" if i % 3 else "no", float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "row int, age string, w string, a string, b string, c double").repartition(3)
    kinds = {"age": "int", "w": "float", "a": "binary", "b": "binary", "c": "int"}
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    for k, (columns, to) in enumerate([({"age": "int"}, None), (kinds, None), (kinds, str(tmp_path / "kept"))]):
        spark.sparkContext.setJobGroup(f"check{k}", "")
        out, codes = D.validated(frame, columns, "row", to=to)
        assert jobs(f"check{k}") == (2 if to else jobs("check0"))  # a written table has a shuffle's job more under adaptive execution
    spark.sparkContext.setJobGroup("after", "")
    assert sorted((r["value"], r["code"]) for r in codes["a"].collect()) == [("a", 1), ("b", 0)] and sorted((r["value"], r["code"]) for r in codes["b"].collect()) == [("no", 1), ("yes", 0)]
    assert one(out.where("row in (0, 4)").select("row", "age", "w", "a", "b", "c").orderBy("row")) == [(0, 20, 0.0, 1, 1, 0), (4, 24, 4 / 3, 1, 0, 4)]
    for bad, kind, problem in ((F.when(F.col("row") == 7, "third").otherwise(F.col("a")), "binary", "two values"), (F.lit("x"), "binary", "two values"), (F.when(F.col("row") == 7, "1.2").otherwise("5"), "int", "1 values that are not integers: 1.2"), (F.lit("nan"), "int", "200 values"), (F.when(F.col("row") > 7, "1"), "int", r"null values in bad \(8\)"), (F.lit("1,5"), "float", "not numbers: 1,5")):
        with pytest.raises(ValueError, match=problem):
            D.validated(frame.withColumn("bad", bad), {"age": "int", "bad": kind}, "row")


def test_age_bins_are_right_closed(spark):
    frame = spark.createDataFrame([(20, "F"), (25, "M"), (26, "F"), (40, "F")], "age int, sex string")
    assert one(D.age_histogram(frame, "age", "sex").orderBy("bin")) == [(20, "20-24", 1, 1), (25, "25-29", 1, 0), (30, "30-34", 0, 0), (35, "35-39", 1, 0)]


def test_lookup_and_subset(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "participant_id string, session_id string")
    assert D.lookup(frame, "a").count() == 2 and D.lookup(frame, "a", "2").count() == 1
    pairs = spark.createDataFrame([("a", "1"), ("z", "1"), ("a", "1")], "participant_id string, session_id string")
    on = ["participant_id", "session_id"]
    assert one(D.subset(frame, pairs, on)) == [("a", "1")] and one(D.subset_missing(frame, pairs, on)) == [("z", "1")]


def test_names(spark):
    row = spark.range(1).select(names.canonical_feature(F.lit("QT1*BLUR")), names.canonical_feature(F.lit("plugin_A")), names.participant(F.lit("sub-x")), names.session(F.lit("N/A")), names.bids_id(F.lit("7"), F.lit("ses-1")), names.entity(F.lit("a/sub-1_hemi-L_label-x.gii"), "hemi"), names.entity(F.lit("a/sub-1.gii"), "ses"), names.for_structure(F.lit("thickness"), F.lit("subcortical"))).first()
    assert tuple(row) == ("qT1*blur", "plugin_A", "sub-x", None, "sub-7_ses-1", "L", None, "volume")


def test_inventory(spark):
    grid_ = spark.createDataFrame([(1, "a", "x", True), (1, "a", "y", False), (1, "b", "x", True), (2, "a", "x", True), (2, "a", "y", True), (2, "b", "x", False)], "subject int, feature string, structure string, present boolean")
    assert sorted(one(inventory.validation(grid_, ["subject"], "feature", "structure"))) == [(1, "a", True, False), (1, "b", True, True), (2, "a", True, True), (2, "b", False, False)]
    assert sorted(one(inventory.completeness(grid_, ["subject"], "feature"))) == [(1, 1, "a"), (2, 1, "b")]
    row = inventory.validation_summary(grid_, ["subject"]).first()
    assert (row["complete"], row["files"], row["found"], row["verdict"]) == (0, 6, 4, "error")
    assert inventory.validation_summary(grid_.limit(0), ["subject"]).first()["verdict"] == "error"
    many = spark.range(15).select(F.lit(1).alias("subject"), "id")
    top = one(inventory.first_missing(many, ["subject"], ["id"], 10).orderBy("id"))
    assert len(top) == 10 and top[0][3] == 5
    with pytest.raises(ValueError):
        inventory.expected_grid(many.select("subject"), spark.range(10_001))


def encode_map(values, encoding, ending="LittleEndian"):
    raw = np.asarray(values, "<f4" if ending == "LittleEndian" else ">f4").tobytes()
    text = " ".join(map(str, values)) if encoding == "ASCII" else base64.b64encode(zlib.compress(raw) if encoding == "GZipBase64Binary" else raw).decode()
    return f'<GIFTI><DataArray Intent="NIFTI_INTENT_SHAPE" DataType="NIFTI_TYPE_FLOAT32" Encoding="{encoding}" Endian="{ending}" Dimensionality="1" Dim0="{len(values)}"><Data>{text}</Data></DataArray></GIFTI>'.encode()


def test_surface_files(spark, tmp_path):
    (tmp_path / "a.func.gii").write_bytes(encode_map([1, 2.5], "GZipBase64Binary"))
    (tmp_path / "b.func.gii").write_bytes(encode_map([3, 4], "ASCII"))
    (tmp_path / "c.func.gii").write_bytes(encode_map([5, 6], "Base64Binary", "BigEndian"))
    (tmp_path / "d.func.gii.gz").write_bytes(gzip.compress(encode_map([7, 8], "ASCII")))
    (tmp_path / "e.func.gii").write_bytes(b"not xml")
    good, bad = maps.read_surface_files(spark, str(tmp_path))
    assert sorted(tuple(r["values"]) for r in good.collect()) == [(1, 2.5), (3, 4), (5, 6), (7, 8)]
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["e.func.gii"]
    assert maps.unpack(good, ["path"]).count() == 8
    assert maps.inventory(spark, str(tmp_path)).count() == 5


def test_region_text_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(1, "# Title"), (1, "  1  26 12 100.5 Left"), (1, " 2 49  3 7.0 Right"), (1, "3 999 1 1 Other"), (1, "")], "participant_id int, value string")
    row = maps.region_statistics(lines, ["participant_id"]).first()
    assert row["Laccumb"] == 100.5 and row["Rthal"] == 7.0 and row["Lput"] is None
    wide = maps.union_wide([spark.createDataFrame([(1, 2.0)], "participant_id int, Lput double"), spark.createDataFrame([(2, 3.0)], "participant_id int, Rput double")])
    assert sorted(one(maps.region_long(wide, ["participant_id"]))) == [(1, "Lput", 2.0), (2, "Rput", 3.0)]
    scores = spark.createDataFrame([(1, 0, 1.5, "zscore", "cortex", "FA", "regional")], "participant_id int, vertex int, score double, method string, structure string, feature string, analysis string")
    for _ in range(2):
        maps.write_scores(scores, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert maps.feature_label(["FA", "qT1*blur", "ADC"]) == "FA-ADC"


def test_nearest_is_exact(spark):
    r = np.random.default_rng(0)
    s, t = r.normal(size=(200, 3)) * [5, 5, 0.1], np.vstack([r.normal(size=(30, 3)) * 6, [[100, 100, 100]]])
    source = spark.createDataFrame([(i, *map(float, p), float(i)) for i, p in enumerate(s)], "source int, x double, y double, z double, value double")
    target = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)], "target int, x double, y double, z double")
    got = {x["target"]: x["source"] for x in mesh.nearest_resample(target, source).collect()}
    assert got == {i: int(((s - p) ** 2).sum(1).argmin()) for i, p in enumerate(t)}


def test_imputation_without_neighbours(spark):
    values = spark.createDataFrame([(0, 0.0), (1, 4.0), (2, 0.0), (3, float("nan"))], "vertex int, value double")
    edge = spark.createDataFrame([(0, 1), (1, 0), (0, 3), (3, 0)], "a int, b int")
    got = dict(one(mesh.neighbour_impute(values, edge, [], ["value"]).select("vertex", "value")))
    assert got[0] == 4.0 and got[1] == 4.0 and got[2] == 0.0 and math.isnan(got[3])


def test_signed_depth_definition(spark):
    d = [float(x) for x in range(1, 9)]
    frame = spark.createDataFrame([(1, e, x) for e, x in enumerate(d)], "v int, e int, distance double")
    got = [r["depth"] for r in mesh.signed_depth(frame, ["v"]).orderBy("slot").collect()]
    want = [0.0] * 12
    for e in range(5):
        want[e] = -sum(d[e:5])
    for e in range(5, 8):
        want[e + 1] = want[e] + d[e]
    assert got == want


def test_regions_and_resampling(spark):
    sizes = spark.createDataFrame([("a", 2), ("b", 3)], "region string, n_vertices int")
    values = spark.createDataFrame([(1, "a", 5.0)], "participant_id int, region string, value double")
    got = sorted(one(mesh.region_to_vertex(values, sizes, ["participant_id"])))
    assert got == [(1, "a", 0, 5.0), (1, "a", 1, 5.0), (1, "b", 0, 0.0), (1, "b", 1, 0.0), (1, "b", 2, 0.0)]
    w = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)], "target_vertex int, source_vertex int, weight double")
    v = spark.createDataFrame([(0, 2.0), (1, 4.0)], "vertex int, value double")
    assert sorted(one(mesh.weighted_resample(v, w, []))) == [(0, 3.0), (1, 4.0)]
    assert sorted(one(mesh.largest_resample(v, w, []))) == [(0, 2.0), (1, 4.0)]


def test_grids_against_numpy(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(4, 3, 5))
    a[0, 0, 0] = np.nan
    places = list(itertools.product(range(4), range(3), range(5)))
    frame = spark.createDataFrame([(i, j, k, float(a[i, j, k])) for i, j, k in places], "i int, j int, k int, value double")
    box = {(x["i"], x["j"], x["k"]): x["value"] for x in grid.box_mean(frame, []).collect()}
    for i, j, k in places:
        assert math.isclose(box[i, j, k], np.nanmean(a[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2, max(0, k - 1) : k + 2]), rel_tol=1e-9)
    b = np.nan_to_num(a)
    clean = frame.withColumn("value", F.nanvl("value", F.lit(0.0)))
    slopes = np.gradient(b, 0.5, 1.0, 2.0)
    for x in grid.gradient(clean, [], (0.5, 1.0, 2.0)).collect():
        assert all(math.isclose(x[g], s[x["i"], x["j"], x["k"]], abs_tol=1e-9) for g, s in zip(("gi", "gj", "gk"), slopes, strict=True))
    point = spark.createDataFrame([(1, 1.25, 0.5, 2.0), (2, 3.5, 2.5, 4.5)], "id int, x double, y double, z double")
    got = dict(one(grid.trilinear(point, clean, ["id"])))
    assert math.isclose(got[1], 0.75 * (b[1, 0, 2] + b[1, 1, 2]) / 2 + 0.25 * (b[2, 0, 2] + b[2, 1, 2]) / 2)
    assert math.isclose(got[2], b[3, 2, 4] / 8)
    regions = spark.createDataFrame([(1, "one"), (2, "two")], "label int, region string")
    labels = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1)], "i int, j int, k int, label int")
    means = dict(one(grid.region_mean(frame, labels, regions, [])))
    assert math.isclose(means["one"], a[0, 0, 1]) and math.isnan(means["two"])


def test_nearest_resample_far_and_placeless_points(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1e15, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0)], "target long, x double, y double, z double")
    sources = spark.createDataFrame([(7, 0.5, 0.0, 0.0, 1.0), (8, 3.0, 0.0, 0.0, 2.0), (9, float("inf"), 0.0, 0.0, 3.0)], "source long, x double, y double, z double, value double")
    got = {r["target"]: r["source"] for r in mesh.nearest_resample(targets.where("target <> 2"), sources, 2).collect()}
    assert got == {1: 7}
    assert {r["target"]: r["source"] for r in mesh.nearest_resample(targets.withColumn("x", F.col("x") / 1e14), sources, 2).collect()} == {1: 7, 2: 8}
    assert mesh.nearest_resample(targets, sources.where("source > 100"), 2).count() == 0
