"""Cohort scores, masks and summaries on the map, region and series views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixtures as X
from cohortspark.functions.scores import attenuate, rounded
from cohortspark.operators import gram, grid, mesh, normative, series
from cohortspark.plans import scoring
from cohortspark.sources import maps

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = X.with_views(views, sql) if views else sql
        return f

    return add


def _split(frame):
    return frame.where("cohort = 'control'"), frame.where("cohort = 'patient'")


def _out(frame, *values):
    """Values rounded for comparison, integers as BIGINT."""
    whole = [c for c, t in frame.dtypes if t in ("int", "smallint") and c not in values]
    return frame.withColumns({**{c: rounded(F.col(c)) for c in values}, **{c: F.col(c).cast("bigint") for c in whole}})


Z = "m AS (SELECT {k}, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS sd, count(*) AS n FROM {t} WHERE cohort = 'control' GROUP BY ALL)"


@query("zscore_map", "e", ", " + Z.format(k="hemi, vertex", t="e") + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round((value - mu) / sd, 6) + 0.0 AS score FROM e JOIN m USING (hemi, vertex) WHERE cohort = 'patient' AND n >= 2")
def zscore_map(spark, sf_dir):
    return _out(normative.zscore(*_split(X.surface_maps(spark, sf_dir)), ["hemi", "vertex"]), "score")


ZD = ", " + Z.format(k="hemi, vertex, depth", t="ed") + ", s AS (SELECT participant_id, hemi, vertex, avg((value - mu) / sd) AS score FROM ed JOIN m USING (hemi, vertex, depth) WHERE cohort = 'patient' AND n >= 2 GROUP BY ALL)"


@query("zscore_depth", "e ed", ZD + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(score, 6) + 0.0 AS score FROM s")
def zscore_depth(spark, sf_dir):
    return _out(normative.zscore(*_split(X.layered_maps(spark, sf_dir)), ["hemi", "vertex"], depth="depth"), "score")


@query("zscore_nan", "e ed", ", m AS (SELECT hemi, vertex, depth, avg(value) FILTER (vertex <> 0 OR participant_id % 7 <> 0) AS mu, stddev_pop(value) FILTER (vertex <> 0 OR participant_id % 7 <> 0) AS sd FROM ed WHERE cohort = 'control' AND depth < 3 GROUP BY ALL) SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(avg((value - mu) / sd), 6) + 0.0 AS score FROM ed JOIN m USING (hemi, vertex, depth) WHERE cohort = 'patient' GROUP BY ALL")
def zscore_nan(spark, sf_dir):
    controls, patients = _split(X.layered_maps(spark, sf_dir))
    gaps = controls.withColumn("value", F.when((F.col("vertex") == 0) & (F.col("participant_id") % 7 == 0), F.lit(float("nan"))).otherwise(F.col("value")))
    return _out(normative.zscore_nan(gaps, patients, ["hemi", "vertex"], depth="depth"), "score")


@query("depth_mean", "e ed", "SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(avg(value), 6) + 0.0 AS value FROM ed GROUP BY ALL")
def depth_mean(spark, sf_dir):
    return _out(normative.depth_mean(X.layered_maps(spark, sf_dir), ["participant_id", "hemi", "vertex"]), "value")


ASYM = "a AS (SELECT participant_id, cohort, vertex, CASE WHEN (l + r) / 2 > 0 THEN (l - r) / ((l + r) / 2) ELSE (l + r) / 2 END AS value FROM (SELECT participant_id, cohort, vertex, max(value) FILTER (hemi = 'L') AS l, max(value) FILTER (hemi = 'R') AS r FROM e GROUP BY ALL) WHERE l IS NOT NULL AND r IS NOT NULL)"


@query("asymmetry_map", "e", ", " + ASYM + " SELECT participant_id, CAST(vertex AS BIGINT) AS vertex, round(value, 6) + 0.0 AS value FROM a")
def asymmetry_map(spark, sf_dir):
    return _out(normative.asymmetry_maps(X.surface_maps(spark, sf_dir), ["participant_id", "vertex"]), "value")


@query("asymmetry_zscore", "e", ", " + ASYM + ", " + Z.format(k="vertex", t="a") + " SELECT participant_id, CAST(vertex AS BIGINT) AS vertex, round((value - mu) / sd, 5) + 0.0 AS score FROM a JOIN m USING (vertex) WHERE cohort = 'patient' AND n >= 2")
def asymmetry_zscore(spark, sf_dir):
    """The whole plan: asymmetry of every subject, cohort model, patients' scores."""
    scores = scoring.score_cohort(X.surface_maps(spark, sf_dir), None, method="zscore", analyses=("asymmetry",), keys=["hemi"])
    return scores.select("participant_id", F.col("vertex").cast("bigint").alias("vertex"), rounded(F.col("score"), 5).alias("score"))


S = ", " + Z.format(k="hemi, vertex", t="e") + ", s AS (SELECT participant_id, hemi, vertex, (value - mu) / sd AS score FROM e JOIN m USING (hemi, vertex) WHERE cohort = 'patient' AND n >= 2)"


def _scores(spark, sf_dir):
    return normative.zscore(*_split(X.surface_maps(spark, sf_dir)), ["hemi", "vertex"])


@query("score_summary", "e", S + " SELECT participant_id, hemi, count(*) AS n, round(avg(score), 6) + 0.0 AS mean_score, round(stddev_pop(score), 6) + 0.0 AS std_score FROM s GROUP BY ALL")
def score_summary(spark, sf_dir):
    return _out(normative.score_summary(_scores(spark, sf_dir), ["participant_id", "hemi"]), "mean_score", "std_score")


@query("score_attenuate", "e", S + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(CASE WHEN abs(score) < 1.96 THEN score * 0.3 ELSE score END, 6) + 0.0 AS score FROM s")
def score_attenuate(spark, sf_dir):
    return _out(_scores(spark, sf_dir).withColumn("score", attenuate(F.col("score"))), "score")


@query("report_means", "e", S + " SELECT participant_id, hemi, round(avg(CASE WHEN abs(score) < 1.96 THEN score * 0.3 ELSE score END), 6) + 0.0 AS mean FROM s GROUP BY ALL")
def report_means(spark, sf_dir):
    return _out(_scores(spark, sf_dir).groupBy("participant_id", "hemi").agg(F.avg(attenuate(F.col("score"))).alias("mean")), "mean")


@query("score_counts", "e", S + " SELECT hemi, count(*) AS n, count(DISTINCT participant_id) AS n_patients FROM s GROUP BY hemi")
def score_counts(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("hemi").agg(F.count("*").alias("n"), F.count_distinct("participant_id").alias("n_patients"))


@query("map_scan", "e", "SELECT cohort, hemi, count(*) AS n, count(DISTINCT participant_id) AS n_subjects, round(sum(value), 4) + 0.0 AS total FROM e GROUP BY ALL")
def map_scan(spark, sf_dir):
    packed = X.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("values"))
    side, _ = grid.hemisphere(F.col("vertex"), 32)
    long = maps.unpack(packed, ["vec_id", "label"]).withColumn("hemi", side).withColumn("cohort", F.when(F.col("label") < 5, "control").otherwise("patient"))
    return long.groupBy("cohort", "hemi").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_subjects"), rounded(F.sum("value"), 4).alias("total"))


@query("hemi_split", None, "SELECT vec_id, p - 1 AS place, CASE WHEN p <= 32 THEN 'L' ELSE 'R' END AS hemi, (p - 1) % 32 AS vertex FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS p FROM embeddings)")
def hemi_split(spark, sf_dir):
    side, vertex = grid.hemisphere(F.col("place"), 32)
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "v")).select("vec_id", F.col("place").cast("bigint").alias("place"), side.alias("hemi"), vertex.cast("bigint").alias("vertex"))


@query("medial_wall", "e", ", v AS (SELECT DISTINCT hemi, vertex FROM e), c AS (SELECT hemi, vertex FROM e GROUP BY ALL HAVING avg(value) > 0) SELECT hemi, CAST(vertex AS BIGINT) AS vertex FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.hemi = v.hemi AND c.vertex = v.vertex)")
def medial_wall(spark, sf_dir):
    e = X.surface_maps(spark, sf_dir)
    cortex = e.groupBy("hemi", "vertex").agg(F.avg("value").alias("m")).where("m > 0")
    return _out(mesh.medial_wall(e.select("hemi", "vertex").distinct(), cortex, ["hemi", "vertex"]))


@query("mask_vertices", "e", ", c AS (SELECT hemi, vertex FROM e GROUP BY ALL HAVING avg(value) <= 0) SELECT participant_id, hemi, count(*) AS n, count(*) FILTER (masked) AS n_masked, round(sum(value) FILTER (NOT masked), 6) + 0.0 AS kept FROM (SELECT e.*, EXISTS (SELECT 1 FROM c WHERE c.hemi = e.hemi AND c.vertex = e.vertex) AS masked FROM e) GROUP BY ALL")
def mask_vertices(spark, sf_dir):
    e = X.surface_maps(spark, sf_dir)
    wall = e.groupBy("hemi", "vertex").agg(F.avg("value").alias("m")).where("m <= 0")
    masked = mesh.mask_vertices(e, wall, ["hemi", "vertex"])
    nan = F.isnan("value")
    return _out(masked.groupBy("participant_id", "hemi").agg(F.count("*").alias("n"), F.count_if(nan).alias("n_masked"), F.sum(F.when(~nan, F.col("value"))).alias("kept")), "kept")


def _with_demo(spark, sf_dir):
    return X.surface_maps(spark, sf_dir).join(X.demographics(spark, sf_dir), "participant_id")


W1 = "x AS (SELECT e.*, AGE, BALANCE FROM e JOIN dm USING (participant_id)), m AS (SELECT hemi, vertex, avg(value) AS my, avg(AGE) AS m1, var_pop(value) AS vy, covar_pop(AGE, value) AS y1, covar_pop(AGE, AGE) AS c11, count(*) AS n FROM x WHERE cohort = 'control' GROUP BY ALL HAVING count(*) >= 2)"


@query("wscore_p1", "e dm", ", " + W1 + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round((value - my - y1 / c11 * (AGE - m1)) / sqrt(greatest(0, vy - y1 / c11 * y1)), 6) + 0.0 AS score FROM x JOIN m USING (hemi, vertex) WHERE cohort = 'patient'")
def wscore_p1(spark, sf_dir):
    return _out(normative.wscore(*_split(_with_demo(spark, sf_dir)), ["hemi", "vertex"], ["AGE"]), "score")


W2 = "x AS (SELECT e.*, AGE, BALANCE FROM e JOIN dm USING (participant_id)), m AS (SELECT hemi, vertex, my, m1, m2, (y1 * c22 - y2 * c12) / (c11 * c22 - c12 * c12) AS b1, (y2 * c11 - y1 * c12) / (c11 * c22 - c12 * c12) AS b2, y1, y2, vy FROM (SELECT hemi, vertex, avg(value) AS my, avg(AGE) AS m1, avg(BALANCE) AS m2, var_pop(value) AS vy, covar_pop(AGE, value) AS y1, covar_pop(BALANCE, value) AS y2, covar_pop(AGE, AGE) AS c11, covar_pop(BALANCE, BALANCE) AS c22, covar_pop(AGE, BALANCE) AS c12 FROM x WHERE cohort = 'control' GROUP BY ALL HAVING count(*) >= 2))"


@query("wscore_map", "e dm", ", " + W2 + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round((value - my - b1 * (AGE - m1) - b2 * (BALANCE - m2)) / sqrt(greatest(0, vy - b1 * y1 - b2 * y2)), 6) + 0.0 AS score FROM x JOIN m USING (hemi, vertex) WHERE cohort = 'patient'")
def wscore_map(spark, sf_dir):
    return _out(normative.wscore(*_split(_with_demo(spark, sf_dir)), ["hemi", "vertex"], ["AGE", "BALANCE"]), "score")


W3 = "x AS (SELECT e.*, AGE, BALANCE, CASE WHEN SEX = 'M' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS MALE FROM e JOIN dm USING (participant_id)), c AS (SELECT hemi, vertex, avg(value) AS my, avg(AGE) AS m1, avg(BALANCE) AS m2, avg(MALE) AS m3, var_pop(value) AS vy, covar_pop(AGE, value) AS y1, covar_pop(BALANCE, value) AS y2, covar_pop(MALE, value) AS y3, covar_pop(AGE, AGE) AS a, covar_pop(AGE, BALANCE) AS b, covar_pop(AGE, MALE) AS c, covar_pop(BALANCE, BALANCE) AS d, covar_pop(BALANCE, MALE) AS e, covar_pop(MALE, MALE) AS f FROM x WHERE cohort = 'control' GROUP BY ALL HAVING count(*) >= 2), i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c), m AS (SELECT *, ((d * f - e * e) * y1 + (c * e - b * f) * y2 + (b * e - c * d) * y3) / det AS b1, ((c * e - b * f) * y1 + (a * f - c * c) * y2 + (b * c - a * e) * y3) / det AS b2, ((b * e - c * d) * y1 + (b * c - a * e) * y2 + (a * d - b * b) * y3) / det AS b3 FROM i)"


@query("wscore_general", "e dm", ", " + W3 + " SELECT participant_id, x.hemi, CAST(x.vertex AS BIGINT) AS vertex, round((value - my - b1 * (AGE - m1) - b2 * (BALANCE - m2) - b3 * (MALE - m3)) / sqrt(greatest(0, vy - b1 * y1 - b2 * y2 - b3 * y3)), 6) + 0.0 AS score FROM x JOIN m ON x.hemi = m.hemi AND x.vertex = m.vertex WHERE cohort = 'patient'")
def wscore_general(spark, sf_dir):
    """Three covariates, one of them binary: moments and pseudo-inverse."""
    frame = _with_demo(spark, sf_dir).withColumn("MALE", F.when(F.col("SEX") == "M", 1.0).otherwise(0.0))
    return _out(normative.wscore(*_split(frame), ["hemi", "vertex"], ["AGE", "BALANCE", "MALE"]), "score")


@query("deconfound", "e dm", ", " + W2 + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(value - my - b1 * (AGE - m1) - b2 * (BALANCE - m2), 6) + 0.0 AS value FROM x JOIN m USING (hemi, vertex)")
def deconfound(spark, sf_dir):
    return _out(normative.deconfound(_with_demo(spark, sf_dir), F.col("cohort") == "control", ["hemi", "vertex"], ["AGE", "BALANCE"]), "value")


@query("patients_without_demo", "e dm", "SELECT DISTINCT participant_id FROM e WHERE cohort = 'patient' AND participant_id NOT IN (SELECT participant_id FROM dm WHERE SITE <> 'BUILDING')")
def patients_without_demo(spark, sf_dir):
    """One site sent no demographics: its patients can't have W-scores."""
    return scoring.patients_without_demographics(X.surface_maps(spark, sf_dir), X.demographics(spark, sf_dir).where("SITE <> 'BUILDING'"))


COHORT = ", " + ASYM + ", u AS (SELECT participant_id, cohort, 'regional' AS analysis, hemi, vertex, value FROM e UNION ALL SELECT participant_id, cohort, 'asymmetry', 'L', vertex, value FROM a), " + Z.format(k="analysis, hemi, vertex", t="u").replace("m AS", "zm AS", 1) + ", " + W2.replace("e.*", "u.*").replace("FROM e JOIN", "FROM u JOIN").replace("hemi, vertex", "analysis, hemi, vertex")


@query("cohort_scores", "e dm", COHORT + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, 'zscore' AS method, analysis, round((value - mu) / sd, 5) + 0.0 AS score FROM u JOIN zm USING (analysis, hemi, vertex) WHERE cohort = 'patient' AND n >= 2 UNION ALL SELECT participant_id, hemi, CAST(vertex AS BIGINT), 'wscore', analysis, round((value - my - b1 * (AGE - m1) - b2 * (BALANCE - m2)) / sqrt(greatest(0, vy - b1 * y1 - b2 * y2)), 5) + 0.0 FROM x JOIN m USING (analysis, hemi, vertex) WHERE cohort = 'patient'")
def cohort_scores(spark, sf_dir):
    """The whole plan by both methods: regional and asymmetry maps of every patient."""
    e, dm = X.surface_maps(spark, sf_dir), X.demographics(spark, sf_dir)
    both = [scoring.score_cohort(e, dm, method=m, covariates=["AGE", "BALANCE"], keys=["hemi"]) for m in scoring.METHODS]
    return both[0].unionByName(both[1]).withColumns({"vertex": F.col("vertex").cast("bigint"), "score": rounded(F.col("score"), 5)})


def _wide(spark, sf_dir):
    return X.layered_maps(spark, sf_dir).groupBy("participant_id", "cohort", "hemi", "vertex").pivot("depth", [0, 1, 2, 3]).agg(F.first("value")).withColumnsRenamed({str(i): f"f{i}" for i in range(4)})


@query("mahalanobis_f2", "e ed", ", w AS (SELECT participant_id, cohort, hemi, vertex, max(value) FILTER (depth = 0) AS f0, max(value) FILTER (depth = 1) AS f1 FROM ed GROUP BY ALL), m AS (SELECT hemi, vertex, avg(f0) AS m0, avg(f1) AS m1, covar_samp(f0, f0) AS s00, covar_samp(f0, f1) AS s01, covar_samp(f1, f1) AS s11 FROM w WHERE cohort = 'control' GROUP BY ALL) SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(sqrt((s11 * (f0 - m0) * (f0 - m0) - 2 * s01 * (f0 - m0) * (f1 - m1) + s00 * (f1 - m1) * (f1 - m1)) / (s00 * s11 - s01 * s01)), 6) + 0.0 AS distance FROM w JOIN m USING (hemi, vertex) WHERE cohort = 'patient'")
def mahalanobis_f2(spark, sf_dir):
    return _out(normative.mahalanobis(*_split(_wide(spark, sf_dir)), ["hemi", "vertex"], ["f0", "f1"]), "distance")


#: Elimination of one feature after the other: each step takes its share of the distance and leaves the others' Schur complement.
M4 = ", w AS (SELECT participant_id, cohort, hemi, vertex, " + ", ".join(f"max(value) FILTER (depth = {i}) AS f{i}" for i in range(4)) + " FROM ed GROUP BY ALL), m AS (SELECT hemi, vertex, " + ", ".join(f"avg(f{i}) AS m{i}" for i in range(4)) + ", " + ", ".join(f"covar_samp(f{i}, f{j}) AS s{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM w WHERE cohort = 'control' GROUP BY ALL), p0 AS (SELECT participant_id, hemi, vertex, s00, s01, s02, s03, s11, s12, s13, s22, s23, s33, f0 - m0 AS d0, f1 - m1 AS d1, f2 - m2 AS d2, f3 - m3 AS d3 FROM w JOIN m USING (hemi, vertex) WHERE cohort = 'patient'), p1 AS (SELECT participant_id, hemi, vertex, d0 * d0 / s00 AS q, s11 - s01 * s01 / s00 AS s11, s12 - s01 * s02 / s00 AS s12, s13 - s01 * s03 / s00 AS s13, s22 - s02 * s02 / s00 AS s22, s23 - s02 * s03 / s00 AS s23, s33 - s03 * s03 / s00 AS s33, d1 - s01 * d0 / s00 AS d1, d2 - s02 * d0 / s00 AS d2, d3 - s03 * d0 / s00 AS d3 FROM p0), p2 AS (SELECT participant_id, hemi, vertex, q + d1 * d1 / s11 AS q, s22 - s12 * s12 / s11 AS s22, s23 - s12 * s13 / s11 AS s23, s33 - s13 * s13 / s11 AS s33, d2 - s12 * d1 / s11 AS d2, d3 - s13 * d1 / s11 AS d3 FROM p1), p3 AS (SELECT participant_id, hemi, vertex, q + d2 * d2 / s22 AS q, s33 - s23 * s23 / s22 AS s33, d3 - s23 * d2 / s22 AS d3 FROM p2)"


@query("mahalanobis", "e ed", M4 + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, round(sqrt(q + d3 * d3 / s33), 6) + 0.0 AS distance FROM p3")
def mahalanobis(spark, sf_dir):
    return _out(normative.mahalanobis(*_split(_wide(spark, sf_dir)), ["hemi", "vertex"], ["f0", "f1", "f2", "f3"]), "distance")


@query("zscore_region", "r", ", " + Z.format(k="region", t="r") + " SELECT participant_id, region, round((value - mu) / sd, 6) + 0.0 AS score FROM r JOIN m USING (region) WHERE cohort = 'patient'")
def zscore_region(spark, sf_dir):
    return _out(normative.zscore(*_split(X.regions(spark, sf_dir)), ["region"], min_controls=1), "score")


RM = ", m AS (SELECT region, count(*) AS n, avg(value) AS my, avg(AGE) AS m1, var_pop(value) AS vy, covar_pop(AGE, value) AS y1, covar_pop(AGE, AGE) AS c11 FROM r WHERE cohort = 'control' GROUP BY region HAVING count(*) >= 2)"


@query("wscore_region", "r", RM + " SELECT participant_id, region, round((value - my - y1 / c11 * (AGE - m1)) / sqrt(greatest(0, vy - y1 / c11 * y1)), 5) + 0.0 AS score FROM r JOIN m USING (region) WHERE cohort = 'patient'")
def wscore_region(spark, sf_dir):
    out = normative.wscore(*_split(X.regions(spark, sf_dir)), ["region"], ["AGE"], regions=True)
    return out.withColumn("score", rounded(F.col("score"), 5))


@query("region_model", "r", RM + " SELECT region, n, round(my - y1 / c11 * m1, 4) + 0.0 AS intercept, round(y1 / c11, 6) + 0.0 AS slope, round(sqrt(greatest(0, vy - y1 / c11 * y1)), 4) + 0.0 AS resid_std FROM m")
def region_model(spark, sf_dir):
    m = normative.wscore_model(_split(X.regions(spark, sf_dir))[0], ["region"], ["AGE"])
    return m.select("region", "n", rounded(F.col("coefficients")[0], 4).alias("intercept"), rounded(F.col("coefficients")[1]).alias("slope"), rounded(F.col("resid_std"), 4).alias("resid_std"))


@query("asymmetry_region", "r", "SELECT participant_id, region, round(CASE WHEN (l + r) / 2 > 0 THEN (l - r) / ((l + r) / 2) ELSE 0.0 END, 6) + 0.0 AS value FROM (SELECT participant_id, substr(region, 2) AS region, max(value) FILTER (region LIKE 'L%') AS l, max(value) FILTER (region LIKE 'R%') AS r FROM r GROUP BY ALL) WHERE l IS NOT NULL AND r IS NOT NULL")
def asymmetry_region(spark, sf_dir):
    return _out(normative.asymmetry_regions(X.regions(spark, sf_dir), ["participant_id"]), "value")


SIDES = [f"{s}{i}" for s in "LR" for i in range(1, 8)]
_PIVOT = ", ".join(f"round(max(value) FILTER (region = '{c}'), 6) + 0.0 AS {c}" for c in SIDES)


@query("region_pivot", "r", f"SELECT participant_id, {_PIVOT} FROM r GROUP BY participant_id")
def region_pivot(spark, sf_dir):
    return _out(maps.region_wide(X.regions(spark, sf_dir), ["participant_id"], SIDES), *SIDES)


@query("region_unpivot", "r", "SELECT participant_id, region, round(value, 6) + 0.0 AS value FROM r WHERE value IS NOT NULL")
def region_unpivot(spark, sf_dir):
    return _out(maps.region_long(maps.region_wide(X.regions(spark, sf_dir), ["participant_id"], SIDES), ["participant_id"]), "value")


_WIDE = ", ".join(f"max(score) FILTER (region = '{c}') AS {c}" for c in SIDES)


@query("region_scores_wide", "r", ", " + Z.format(k="region", t="r") + f", s AS (SELECT participant_id, region, round((value - mu) / sd, 6) + 0.0 AS score FROM r JOIN m USING (region) WHERE cohort = 'patient') SELECT participant_id, {_WIDE} FROM s GROUP BY participant_id")
def region_scores_wide(spark, sf_dir):
    return maps.region_wide(zscore_region(spark, sf_dir).withColumnRenamed("score", "value"), ["participant_id"], SIDES)


@query("feature_covariance", "e", ", w AS (SELECT participant_id, cohort, (CASE WHEN hemi = 'L' THEN 0 ELSE 32 END) + vertex AS f, value FROM e) SELECT a.cohort, CAST(a.f AS BIGINT) AS i, CAST(b.f AS BIGINT) AS j, count(*) AS n, round(covar_samp(a.value, b.value), 6) + 0.0 AS covariance FROM w a JOIN w b ON a.participant_id = b.participant_id AND a.f <= b.f GROUP BY ALL")
def feature_covariance(spark, sf_dir):
    """All covariances of 64 features by cohort, from packed matrices."""
    wide = X.table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "control").otherwise("patient").alias("cohort"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    m = gram.moments(wide, ["cohort"], [f"f{i}" for i in range(64)])
    entry = m.select("cohort", "n", F.posexplode("scatter").alias("k", "s"))
    # row i of the upper triangle begins at k = i (2 * 64 - i + 1) / 2
    row = F.floor((129 - F.sqrt(129.0 * 129 - 8 * F.col("k"))) / 2).cast("bigint")
    column = (F.col("k") - F.expr("i * (129 - i) div 2") + F.col("i")).cast("bigint")
    return entry.withColumn("i", row).withColumn("j", column).select("cohort", "i", "j", "n", rounded(F.col("s") / (F.col("n") - 1)).alias("covariance"))


@query("ts_rmssd", "ts", ", d AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ts) SELECT series_id, round(CASE WHEN count(*) > 1 THEN sqrt(sum(d * d)) / (count(*) - 1) ELSE 'NaN'::DOUBLE END, 6) + 0.0 AS rmssd FROM d GROUP BY series_id")
def ts_rmssd(spark, sf_dir):
    return _out(series.rmssd(X.series(spark, sf_dir), ["series_id"]), "rmssd")


DT = ", l AS (SELECT series_id, coalesce(regr_slope(value, t), 0) AS b, avg(value) AS my, avg(t) AS mt, count(*) AS n FROM ts GROUP BY series_id), dt AS (SELECT series_id, t, n, value - my - b * (t - mt) AS value FROM ts JOIN l USING (series_id))"


@query("ts_detrend", "ts", DT + " SELECT series_id, CAST(t AS BIGINT) AS t, round(value, 6) + 0.0 AS value FROM dt")
def ts_detrend(spark, sf_dir):
    return _out(series.detrend(X.series(spark, sf_dir), ["series_id"]), "value")


AC = ", c AS (SELECT a.series_id, b.t - a.t AS lag, sum(a.value * b.value) AS c FROM ts a JOIN ts b ON a.series_id = b.series_id AND b.t >= a.t GROUP BY ALL), ac AS (SELECT series_id, lag, CASE WHEN z <> 0 THEN c / z ELSE c END AS acf FROM (SELECT *, max(c) FILTER (lag = 0) OVER (PARTITION BY series_id) AS z FROM c))"


@query("ts_acf", "ts", AC + " SELECT series_id, CAST(lag AS BIGINT) AS lag, round(acf, 6) + 0.0 AS acf FROM ac")
def ts_acf(spark, sf_dir):
    return _out(series.acf(X.series(spark, sf_dir), ["series_id"], block=32), "acf")


TS = AC + ", tsc AS (SELECT series_id, 0.65 * coalesce(sum(acf) FILTER (o = 0 AND lag >= 1), 0) AS timescale FROM (SELECT *, sum(CASE WHEN acf < 0 AND lag >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY lag) AS o FROM ac) GROUP BY series_id)"


@query("ts_timescale", "ts", TS + " SELECT series_id, round(timescale, 6) + 0.0 AS timescale FROM tsc")
def ts_timescale(spark, sf_dir):
    return _out(series.timescale(X.series(spark, sf_dir), ["series_id"]), "timescale")


AL = DT + ", sp AS (SELECT series_id, n, k, sqrt(pow(sum(value * cos(2 * pi() * k * t / n)), 2) + pow(sum(value * sin(2 * pi() * k * t / n)), 2)) AS a FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM dt) GROUP BY ALL), al AS (SELECT series_id, coalesce(sum(a) FILTER (k / (n * 0.65) >= 0.01 AND k / (n * 0.65) <= 0.08), 0) AS alff, sum(a) AS total FROM sp GROUP BY series_id)"


@query("ts_alff", "ts", AL + " SELECT series_id, round(alff, 5) + 0.0 AS alff, round(alff / total, 6) + 0.0 AS falff FROM al")
def ts_alff(spark, sf_dir):
    return series.alff(X.series(spark, sf_dir), ["series_id"]).select("series_id", rounded(F.col("alff"), 5).alias("alff"), rounded(F.col("falff")).alias("falff"))


#: Lines of over eight points go by a chirp here, others by two passes, whatever the series' sizes.
@query("ts_spectrum", "ts", DT + " SELECT series_id, CAST(k AS BIGINT) AS k, round(sum(value * cos(2 * pi() * ((k * t) % n) / n)), 4) + 0.0 AS re, round(-sum(value * sin(2 * pi() * ((k * t) % n) / n)), 4) + 0.0 AS im FROM (SELECT *, unnest(range(0, n)) AS k FROM dt) GROUP BY ALL")
def ts_spectrum(spark, sf_dir):
    flat = series.detrend(X.series(spark, sf_dir), ["series_id"])
    return series.fourier(flat, ["series_id"], whole=8).select("series_id", "k", rounded(F.col("re"), 4).alias("re"), rounded(F.col("im"), 4).alias("im"))


RM = ", rm AS (SELECT series_id, sqrt(sum(d * d)) / (count(*) - 1) AS rmssd FROM (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY t) AS d FROM ts) GROUP BY series_id)"
FEATURES = AL + TS + RM + " SELECT series_id, round(rmssd, 6) + 0.0 AS rmssd, round(timescale, 6) + 0.0 AS timescale, round(alff, 5) + 0.0 AS alff, round(alff / total, 6) + 0.0 AS falff FROM al JOIN tsc USING (series_id) JOIN rm USING (series_id)"


@query("ts_features", "ts", FEATURES)
def ts_features(spark, sf_dir):
    f = series.features(X.series(spark, sf_dir), ["series_id"])
    return f.select("series_id", rounded(F.col("rmssd")).alias("rmssd"), rounded(F.col("timescale")).alias("timescale"), rounded(F.col("alff"), 5).alias("alff"), rounded(F.col("falff")).alias("falff"))


@query("ts_features_packed", "ts", FEATURES)
def ts_features_packed(spark, sf_dir):
    """The same features of series held as arrays, the form for long series."""
    packed = X.series(spark, sf_dir).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("values"))
    f = series.packed_features(packed, ["series_id"])
    return f.select("series_id", rounded(F.col("rmssd")).alias("rmssd"), rounded(F.col("timescale")).alias("timescale"), rounded(F.col("alff"), 5).alias("alff"), rounded(F.col("falff")).alias("falff"))
