"""Whole plans: deriving features, distances over stacked features, reports and the status of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixtures as X
from cohortspark.functions.scores import rounded
from cohortspark.operators import inventory, mesh, normative
from cohortspark.plans import deriving, legacy, report, scoring
from cohortspark.queries.scores import AL, M4, RM, TS, S, Z
from cohortspark.queries.space import DEPTH, STEP

QUERIES, ORACLES = {}, {}


def query(name: str, views: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, X.with_views(views, sql)
        return f

    return add


def _out(frame, *values, places=6):
    whole = [c for c, t in frame.dtypes if t in ("int", "smallint")]
    return frame.withColumns({**{c: rounded(F.col(c), places) for c in values}, **{c: F.col(c).cast("bigint") for c in whole}})


# Four columns: two features at two depths. Every ninth subject lacks the second feature.
STACK = ", k AS (SELECT *, CASE WHEN depth < 2 THEN 'a' ELSE 'b' END AS feature FROM ed WHERE participant_id % 9 <> 0), ka AS (SELECT participant_id, cohort, vertex, depth, CASE WHEN (l + r) / 2 > 0 THEN (l - r) / ((l + r) / 2) ELSE (l + r) / 2 END AS value FROM (SELECT participant_id, cohort, vertex, depth, max(value) FILTER (hemi = 'L') AS l, max(value) FILTER (hemi = 'R') AS r FROM k GROUP BY ALL) WHERE l IS NOT NULL AND r IS NOT NULL), src AS (SELECT 'regional' AS analysis, participant_id, cohort, hemi, vertex, depth, value FROM k UNION ALL SELECT 'asymmetry', participant_id, cohort, 'L', vertex, depth, value FROM ka)"


@query("mahalanobis_maps", "e ed", STACK + M4.replace("hemi, vertex", "analysis, hemi, vertex").replace("FROM ed", "FROM src") + " SELECT participant_id, analysis, hemi, CAST(vertex AS BIGINT) AS vertex, round(sqrt(q + d3 * d3 / s33), 4) + 0.0 AS distance FROM p3")
def mahalanobis_maps(spark, sf_dir):
    """Features and depths stacked, subjects that have them all, regional and asymmetry maps."""
    e = X.layered_maps(spark, sf_dir).withColumn("feature", F.when(F.col("depth") < 2, "a").otherwise("b")).withColumn("depth", F.col("depth") % 2)
    some = e.where("participant_id % 9 <> 0 or feature = 'a'")
    return _out(normative.mahalanobis_maps(some, ["hemi", "vertex"], ["a", "b"], depths=[0, 1]), "distance", places=4)


V = ", v AS (SELECT DISTINCT vertex FROM e), t AS (SELECT vertex AS v0, vertex + 1 AS v1, vertex + 8 AS v2 FROM v WHERE vertex % 8 < 7 AND vertex < 24), h AS (SELECT vertex AS a, vertex AS b FROM v UNION SELECT v0, v1 FROM t UNION SELECT v1, v0 FROM t UNION SELECT v0, v2 FROM t UNION SELECT v2, v0 FROM t UNION SELECT v1, v2 FROM t UNION SELECT v2, v1 FROM t), w AS (SELECT a, b, exp(-(pow(a % 8 - b % 8, 2) + pow(a // 8 - b // 8, 2)) / 2.0) AS w FROM h), sm AS (SELECT participant_id, hemi, a AS vertex, sum(w * value) / sum(w) AS value FROM e JOIN w ON vertex = b GROUP BY ALL), cx AS (SELECT participant_id, 'thickness' AS feature, hemi, CAST(vertex // 2 AS BIGINT) AS vertex, sum(0.5 * value) AS value FROM sm GROUP BY ALL)"


def _cortex(spark, sf_dir, signals=None):
    maps = X.surface_maps(spark, sf_dir).select("participant_id", F.lit("thickness").alias("feature"), "hemi", "vertex", "value")
    v = maps.select("vertex").distinct()
    c = F.col("vertex")
    points = v.select("vertex", (c % 8).cast("double").alias("x"), F.floor(c / 8).cast("double").alias("y"), F.lit(0.0).alias("z"))
    triangles = v.where("vertex % 8 < 7 and vertex < 24").select(c.alias("v0"), (c + 1).alias("v1"), (c + 8).alias("v2"))
    weights = v.select(c.alias("source_vertex"), F.floor(c / 2).alias("target_vertex"), F.lit(0.5).alias("weight"))
    return deriving.cortical(maps, points, mesh.edges(triangles, []), weights, sigma=1.0, hops=1, signals=signals)


@query("process_cortex", "e", V + " SELECT participant_id, feature, hemi, vertex, round(value, 6) + 0.0 AS value FROM cx")
def process_cortex(spark, sf_dir):
    return _out(_cortex(spark, sf_dir), "value")


# Every user's events are the signal of a point: 32 points a side, 64 a subject.
SIGNALS = ", ft AS (SELECT series_id // 64 AS participant_id, CASE WHEN (series_id // 32) % 2 = 0 THEN 'L' ELSE 'R' END AS hemi, CAST(series_id % 32 AS INTEGER) AS vertex, rmssd, timescale AS timescales, alff, alff / total AS falff FROM al JOIN tsc USING (series_id) JOIN rm USING (series_id)), am AS (SELECT participant_id, hemi, vertex, 'thickness' AS feature, value FROM e UNION ALL UNPIVOT ft ON rmssd, timescales, alff, falff INTO NAME feature VALUE value), sg AS (SELECT participant_id, feature, hemi, a AS vertex, sum(w * value) / sum(w) AS value FROM am JOIN w ON vertex = b GROUP BY ALL) SELECT participant_id, feature, hemi, CAST(vertex // 2 AS BIGINT) AS vertex, round(sum(0.5 * value), 5) + 0.0 AS value FROM sg GROUP BY participant_id, feature, hemi, vertex // 2"


@query("process_signals", "e ts", V.replace(", cx AS", ", unused AS") + AL + TS + RM + SIGNALS)
def process_signals(spark, sf_dir):
    """The cortical branch with its time series: four features of every signal, smoothed and resampled like the maps."""
    user = F.col("series_id")
    places = [F.floor(user / 64).cast("bigint").alias("participant_id"), F.when(F.floor(user / 32) % 2 == 0, "L").otherwise("R").alias("hemi"), (user % 32).cast("int").alias("vertex")]
    signals = X.series(spark, sf_dir).groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values")).select(*places, "values")
    return _out(_cortex(spark, sf_dir, signals), "value", places=5)


LEGACY = M4.replace("hemi, vertex", "analysis, hemi, vertex").replace("FROM ed", "FROM src").replace("m AS (", "mm AS (").replace("JOIN m USING", "JOIN mm USING")


@query("legacy_run", "e ed", STACK.replace(" WHERE participant_id % 9 <> 0)", ")") + ", all9 AS (SELECT * FROM src WHERE participant_id % 9 <> 0 OR depth < 2), lm AS (SELECT analysis, hemi, vertex, depth, avg(value) AS mu, stddev_pop(value) AS sd FROM all9 WHERE cohort = 'control' GROUP BY ALL), lz AS (SELECT participant_id, hemi, vertex, CASE WHEN depth < 2 THEN 'FA' ELSE 'ADC' END AS feature, analysis, avg((value - mu) / sd) AS score FROM all9 JOIN lm USING (analysis, hemi, vertex, depth) WHERE cohort = 'patient' GROUP BY ALL)" + LEGACY.replace("FROM src", "FROM (SELECT * FROM src WHERE participant_id % 9 <> 0)") + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, feature, analysis, 'zscore' AS method, round(score, 4) + 0.0 AS score FROM lz UNION ALL SELECT participant_id, hemi, CAST(vertex AS BIGINT), 'FA-ADC', analysis, 'mahalanobis', round(sqrt(q + d3 * d3 / s33), 4) + 0.0 FROM p3")
def legacy_run(spark, sf_dir):
    """Two control datasets and the patients, two features at two depths, sides and asymmetry, scores and distances in one table. Every
    ninth subject lacks the second feature."""
    e = X.layered_maps(spark, sf_dir).withColumn("feature", F.when(F.col("depth") < 2, "FA").otherwise("ADC")).withColumn("depth", F.col("depth") % 2)
    some = e.where("participant_id % 9 <> 0 or feature = 'FA'")
    controls = some.where("cohort = 'control'")
    datasets = [controls.where("participant_id % 2 = 0"), controls.where("participant_id % 2 = 1")]
    out = legacy.run_analysis(datasets, some.where("cohort = 'patient'"), features=["FA", "ADC"], depths=[0, 1])
    return _out(out, "score", places=4)


@query("run_cohort", "e", ", ok AS (SELECT * FROM e WHERE participant_id % 5 <> 0 UNION ALL SELECT participant_id, cohort, hemi, vertex, value / 2 FROM e WHERE participant_id % 5 = 0), " + Z.format(k="hemi, vertex", t="ok") + ", s AS (SELECT participant_id, hemi, vertex, (value - mu) / sd AS score FROM ok JOIN m USING (hemi, vertex) WHERE cohort = 'patient' AND n >= 2) SELECT participant_id, hemi, count(*) AS n, round(avg(score), 5) + 0.0 AS mean_score, round(stddev_pop(score), 5) + 0.0 AS std_score FROM s GROUP BY ALL")
def run_cohort(spark, sf_dir):
    """A whole run: every fifth subject has no maps, too few are complete, what is missing is derived, and all are scored."""
    e = X.surface_maps(spark, sf_dir)
    expected = e.select("participant_id", "hemi").distinct()

    def derive(missing):
        return e.join(missing.select("participant_id", "hemi"), ["participant_id", "hemi"]).withColumn("value", F.col("value") / 2)

    run = scoring.run_pipeline(e.where("participant_id % 5 <> 0"), None, expected, covariates=[], method="zscore", keys=["hemi"], error_below=95.0, derive=derive)
    summary = run["summary"].where("analysis = 'regional'")
    return summary.select("participant_id", "hemi", "n", rounded(F.col("mean_score"), 5).alias("mean_score"), rounded(F.col("std_score"), 5).alias("std_score"))


# Each slice of the grid is a subject, its parts the points.
HIP = ", c AS (SELECT k, i + 10 * j AS vertex, i + a AS i, j + b AS j, CASE WHEN a = 1 THEN 0.25 ELSE 0.75 END * CASE WHEN b = 1 THEN 0.5 ELSE 0.5 END AS w FROM vox, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b)), s AS (SELECT c.k, vertex, sum(w * coalesce(value, 0)) AS value FROM c LEFT JOIN vox ON vox.k = c.k AND vox.i = c.i AND vox.j = c.j GROUP BY ALL), hp AS (SELECT CAST(x.k AS BIGINT) AS participant_id, 'T1map' AS feature, 'L' AS hemi, CAST(x.vertex AS BIGINT) AS vertex, sum(exp(-pow(x.vertex - y.vertex, 2) / 2.0) * y.value) / sum(exp(-pow(x.vertex - y.vertex, 2) / 2.0)) AS value FROM s x JOIN s y ON x.k = y.k AND x.vertex // 10 = y.vertex // 10 AND abs(x.vertex - y.vertex) <= 1 GROUP BY ALL)"


def _volumes(spark, sf_dir):
    return X.voxels(spark, sf_dir).select(F.col("k").cast("bigint").alias("participant_id"), F.lit("T1map").alias("feature"), "i", "j", "k", "value", "label")


def _hippocampus(spark, sf_dir):
    vox = _volumes(spark, sf_dir)
    points = vox.select("participant_id", F.lit("L").alias("hemi"), (F.col("i") + 10 * F.col("j")).alias("vertex"), (F.col("i") + 0.25).alias("x"), (F.col("j") + 0.5).alias("y"), F.col("k").cast("double").alias("z"))
    right = points.where("vertex % 10 < 9").select("participant_id", "hemi", F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"))
    return deriving.sampled_maps(points, vox.drop("label"), right.unionByName(right.select("participant_id", "hemi", F.col("b").alias("a"), F.col("a").alias("b"))), sigma=1.0, hops=1)


@query("process_hippocampus", "vox", HIP + " SELECT participant_id, feature, hemi, vertex, round(value, 6) + 0.0 AS value FROM hp")
def process_hippocampus(spark, sf_dir):
    return _out(_hippocampus(spark, sf_dir), "value")


SUB = ", reg AS (SELECT DISTINCT label, 'region' || label AS region FROM vox WHERE label < 15), sb AS (SELECT CAST(k AS BIGINT) AS participant_id, 'T1map' AS feature, region, coalesce(avg(value) FILTER (vox.label = reg.label), 'NaN'::DOUBLE) AS value FROM vox, reg GROUP BY ALL UNION ALL SELECT CAST(k AS BIGINT), 'volume', region, CAST(count(*) AS DOUBLE) FROM vox JOIN reg USING (label) GROUP BY ALL)"


def _subcortex(spark, sf_dir):
    vox = _volumes(spark, sf_dir)
    regions = vox.where("label < 15").select("label", F.concat(F.lit("region"), F.col("label").cast("string")).alias("region")).distinct()
    labels = vox.select("participant_id", "i", "j", "k", "label")
    sizes = labels.join(regions, "label").groupBy("participant_id", "region").agg(F.count("*").cast("double").alias("value"))
    return deriving.subcortical(vox.drop("label"), labels, regions, sizes=sizes)


@query("process_subcortex", "vox", SUB + " SELECT participant_id, feature, region, round(value, 6) + 0.0 AS value FROM sb")
def process_subcortex(spark, sf_dir):
    return _out(_subcortex(spark, sf_dir), "value")


REQ = ", ms AS (SELECT participant_id, 'cortex' AS structure, feature, hemi, CAST(vertex AS VARCHAR) AS point, value FROM cx UNION ALL SELECT participant_id, 'hippocampus', feature, hemi, CAST(vertex AS VARCHAR), value FROM hp UNION ALL SELECT participant_id, 'subcortical', feature, NULL, region, value FROM sb)"
STAT = REQ + ", st AS (SELECT c_custkey AS participant_id, s AS structure, f AS feature, EXISTS (SELECT 1 FROM ms WHERE ms.participant_id = c_custkey AND ms.structure = s AND ms.feature = f) AS ok FROM customer, (VALUES ('cortex', 'thickness'), ('hippocampus', 'T1map'), ('subcortical', 'volume')) r(s, f))"
_ALL = V + HIP.replace("c AS (", "hc AS (", 1).replace("FROM c LEFT", "FROM hc c LEFT") + SUB


def _processed(spark, sf_dir):
    requested = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), F.expr("stack(3, 'cortex', 'thickness', 'hippocampus', 'T1map', 'subcortical', 'volume') as (structure, feature)"))
    return deriving.process_cohort({"cortex": _cortex(spark, sf_dir), "hippocampus": _hippocampus(spark, sf_dir), "subcortical": _subcortex(spark, sf_dir)}, requested)


@query("process_cohort", "e vox", _ALL + REQ + " SELECT participant_id, structure, feature, hemi, point, round(value, 6) + 0.0 AS value FROM ms")
def process_cohort(spark, sf_dir):
    return _out(_processed(spark, sf_dir)["measurements"], "value")


@query("process_failed", "e vox", _ALL + STAT + " SELECT participant_id, string_agg(structure || '/' || feature, ',' ORDER BY structure) AS reasons FROM st WHERE NOT ok GROUP BY participant_id")
def process_failed(spark, sf_dir):
    """The failed list of a processing run."""
    return inventory.failed(_processed(spark, sf_dir)["status"], ["participant_id"], "reason")


LAYERED = ", lp AS (SELECT vertex, l AS layer, x / 2 AS x, y / 10 AS y, z + l * 0.5 AS z FROM mv, (VALUES (0), (1), (2), (3)) ll(l)), c AS (SELECT vertex, layer, CAST(floor(x) AS INTEGER) + a AS i, CAST(floor(y) AS INTEGER) + b AS j, CAST(floor(z) AS INTEGER) + c AS k, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM lp, (VALUES (0), (1)) aa(a), (VALUES (0), (1)) bb(b), (VALUES (0), (1)) cc(c)), sv AS (SELECT vertex, layer, sum(w * coalesce(value, 0)) AS value FROM c LEFT JOIN vox USING (i, j, k) GROUP BY ALL), ly AS (SELECT 0 AS subject_id, vertex, layer, x, y, z, value FROM lp JOIN sv USING (vertex, layer))"
ALONG = ", pr AS (SELECT vertex, 'raw' AS kind, layer AS slot, value FROM ly UNION ALL SELECT vertex, 'gradient', layer, gradient FROM g), h AS (SELECT vertex AS a, vertex AS b FROM mv UNION SELECT a, b FROM me), w AS (SELECT h.a, h.b, exp(-(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) / (2 * 1.5 * 1.5)) AS w FROM h JOIN lp p ON p.vertex = h.a AND p.layer = 0 JOIN lp q ON q.vertex = h.b AND q.layer = 0)"


@query("depth_profile_sampled", "vox mv mt me", LAYERED + STEP + DEPTH + ALONG + " SELECT vertex, kind, CAST(slot AS BIGINT) AS slot, round(value, 4) + 0.0 AS value FROM (SELECT vertex, kind, slot, value FROM pr UNION ALL SELECT vertex, 'distance', layer, distance FROM g UNION ALL SELECT vertex, 'depth', slot, depth FROM dp UNION ALL SELECT a, 'smooth_' || kind, slot, sum(w * value) / sum(w) FROM w JOIN pr ON vertex = b GROUP BY ALL)")
def depth_profile_sampled(spark, sf_dir):
    """A volume sampled at four layers of the sheet, the profile, and its smoothing along the sheet."""
    layer = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    points = X.mesh_vertices(spark, sf_dir).select("vertex", layer.alias("layer"), (F.col("x") / 2).alias("x"), (F.col("y") / 10).alias("y"), "z").withColumn("z", F.col("z") + F.col("layer") * 0.5)
    edge = mesh.edges(X.mesh_triangles(spark, sf_dir), [])
    return _out(deriving.sampled_depth_profile(points, X.voxels(spark, sf_dir), edge, [], sigma=1.5, hops=1), "value", places=4)


def _reports(spark, sf_dir):
    e, dm = X.surface_maps(spark, sf_dir), X.demographics(spark, sf_dir)
    scores = normative.zscore(e.where("cohort = 'control'"), e.where("cohort = 'patient'"), ["hemi", "vertex"])
    controls = dm.join(e.where("cohort = 'control'").select("participant_id").distinct(), "participant_id", "left_semi")
    return report.subject_reports(scores, dm, controls, age="AGE", sex="SEX", group=["hemi"])


@query("report_ages", "e dm", ", ctl AS (SELECT * FROM dm WHERE participant_id IN (SELECT participant_id FROM e WHERE cohort = 'control')), x AS (SELECT CAST(floor(min(AGE) / 5) * 5 AS INTEGER) AS lo, max(AGE) AS hi FROM ctl), b AS (SELECT CAST(greatest(lo, ceil(AGE / 5) * 5 - 5) AS INTEGER) AS bin, SEX FROM ctl, x), s AS (SELECT unnest(range(lo, CAST(greatest(lo, ceil(hi / 5) * 5 - 5) AS INTEGER) + 1, 5)) AS bin FROM x), hist AS (SELECT s.bin, count(*) FILTER (SEX = 'F') AS n_female, count(*) FILTER (SEX = 'M') AS n_male FROM s LEFT JOIN b USING (bin) GROUP BY s.bin) SELECT participant_id, CAST(bin AS BIGINT) AS bin, bin || '-' || (bin + 4) AS label, n_female, n_male, coalesce(AGE >= lo AND bin = greatest(lo, ceil(AGE / 5) * 5 - 5), false) AS own FROM hist, x, dm WHERE participant_id IN (SELECT participant_id FROM e WHERE cohort = 'patient')")
def report_ages(spark, sf_dir):
    return _out(_reports(spark, sf_dir)["ages"])


@query("report_subjects", "e dm", S + " SELECT participant_id, hemi, AGE, SEX, round(avg(CASE WHEN abs(score) < 1.96 THEN score * 0.3 ELSE score END), 6) + 0.0 AS mean, round(arg_max(score, abs(score)), 6) + 0.0 AS extreme, count(*) FILTER (abs(score) >= 1.96) AS n_beyond, count(*) AS n FROM (SELECT s.*, CAST(AGE AS BIGINT) AS AGE, SEX FROM s JOIN dm USING (participant_id)) GROUP BY ALL")
def report_subjects(spark, sf_dir):
    tables = _reports(spark, sf_dir)
    return _out(tables["means"].join(tables["identity"], "participant_id").select("participant_id", "hemi", "AGE", "SEX", "mean", "extreme", "n_beyond", "n"), "mean", "extreme")
