"""Demographics checks and completeness accounting on the demographics and inventory views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark import fixtures as X
from cohortspark.functions import names
from cohortspark.functions.scores import rounded
from cohortspark.operators import inventory
from cohortspark.sources import demographics as D
from cohortspark.sources import maps

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None = None, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = X.with_views(views, sql) if views else sql
        return f

    return add


@query("demo_load", None, "SELECT c_custkey AS participant_id, c_nationkey AS session_id, round(c_acctbal, 6) + 0.0 AS balance FROM customer")
def demo_load(spark, sf_dir):
    frame = D.rename(X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("SES"), "c_acctbal"))
    return frame.select("participant_id", "session_id", rounded(F.col("c_acctbal")).alias("balance"))


@query("demo_union", None, "SELECT c_custkey AS id, round(c_acctbal, 6) + 0.0 AS balance, 'Dataset000' AS dataset FROM customer UNION ALL SELECT s_suppkey, round(s_acctbal, 6) + 0.0, 'Dataset001' FROM supplier")
def demo_union(spark, sf_dir):
    a = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    return D.union([a, b]).withColumn("balance", rounded(F.col("balance")))


@query("cohort_union", None, "SELECT dataset, count(*) AS n, round(avg(balance), 4) + 0.0 AS mean FROM (SELECT c_acctbal AS balance, 'Dataset000' AS dataset FROM customer UNION ALL SELECT s_acctbal, 'Dataset001' FROM supplier) GROUP BY dataset")
def cohort_union(spark, sf_dir):
    return demo_union(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), rounded(F.avg("balance"), 4).alias("mean"))


def _pairs(spark, sf_dir):
    """Wanted pairs: one for each order's customer; every eleventh asks for an id that does not exist."""
    key = F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return X.table(spark, sf_dir, "orders").select(key.alias("participant_id"))


PAIRS = ", p AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS participant_id FROM orders)"


@query("demo_subset", "dm", PAIRS + " SELECT participant_id, AGE, SEX FROM dm WHERE participant_id IN (SELECT participant_id FROM p)")
def demo_subset(spark, sf_dir):
    return D.subset(X.demographics(spark, sf_dir), _pairs(spark, sf_dir), ["participant_id"]).select("participant_id", "AGE", "SEX")


@query("demo_subset_missing", "dm", PAIRS + " SELECT DISTINCT participant_id FROM p WHERE participant_id NOT IN (SELECT participant_id FROM dm)")
def demo_subset_missing(spark, sf_dir):
    return D.subset_missing(X.demographics(spark, sf_dir), _pairs(spark, sf_dir), ["participant_id"])


@query("demo_null_audit", "dm", ", n AS (SELECT count(*) FILTER (participant_id % 5 = 0) AS a, count(*) FILTER (BALANCE IS NULL) AS b FROM dm) SELECT 'AGE' AS \"column\", a AS nulls FROM n UNION ALL SELECT 'BALANCE', b FROM n")
def demo_null_audit(spark, sf_dir):
    frame = X.demographics(spark, sf_dir).withColumn("AGE", F.when(F.col("participant_id") % 5 != 0, F.col("AGE")))
    return D.null_counts(frame, ["AGE", "BALANCE"])


@query("demo_int_check", "dm", "SELECT DISTINCT round(BALANCE, 6) + 0.0 AS value FROM dm WHERE abs(BALANCE - trunc(BALANCE)) > 1e-8 + 1e-5 * abs(trunc(BALANCE))")
def demo_int_check(spark, sf_dir):
    return D.not_integers(X.demographics(spark, sf_dir), "BALANCE").select(rounded(F.col("value")).alias("value"))


@query("demo_validated", "dm", ", first AS (SELECT lower(SEX) AS v FROM dm ORDER BY row_ordinal LIMIT 1) SELECT participant_id, AGE, round(BALANCE, 6) + 0.0 AS BALANCE, CASE WHEN lower(SEX) = (SELECT v FROM first) THEN 1 ELSE 0 END AS SEX FROM dm")
def demo_validated(spark, sf_dir):
    """Text columns checked and converted in one pass, as they come from a CSV file."""
    text = X.demographics(spark, sf_dir).select("participant_id", "row_ordinal", *[F.col(c).cast("string").alias(c) for c in ("AGE", "BALANCE", "SEX")])
    out, _ = D.validated(text, {"AGE": "int", "BALANCE": "float", "SEX": "binary"}, "row_ordinal")
    return out.select("participant_id", "AGE", rounded(F.col("BALANCE")).alias("BALANCE"), "SEX")


@query("demo_inherited", "dm", ", first AS (SELECT lower(SEX) AS v FROM dm WHERE participant_id % 3 <> 0 ORDER BY row_ordinal LIMIT 1) SELECT participant_id, AGE, CASE WHEN lower(SEX) = (SELECT v FROM first) THEN 1 ELSE 0 END AS SEX FROM dm WHERE participant_id % 3 = 0")
def demo_inherited(spark, sf_dir):
    """Patients that declare no columns take those of the controls, and their codes, though a patient's value is seen first."""
    dm = X.demographics(spark, sf_dir).withColumn("AGE", F.col("AGE").cast("string"))
    _, reference = D.normative(dm.where("participant_id % 3 <> 0"), "row_ordinal", {"AGE": "int", "SEX": "binary"})
    patients, _ = D.normative(dm.where("participant_id % 3 = 0").withColumn("row_ordinal", -F.col("row_ordinal")), "row_ordinal", reference=reference)
    return patients.select("participant_id", "AGE", "SEX")


@query("report_dates", None, "SELECT user_id AS participant_id, strftime(max(ts), '%B %d, %Y') AS printed FROM events GROUP BY user_id")
def report_dates(spark, sf_dir):
    """The date of each subject's last event as reports print it."""
    last = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("participant_id")).agg(F.max("ts").alias("last"))
    return last.select("participant_id", names.report_date(F.col("last")).alias("printed"))


CODES = ", f AS (SELECT lower(SEX) AS value, min(row_ordinal) AS seen FROM dm GROUP BY ALL), codes AS (SELECT value, CASE WHEN seen = (SELECT min(seen) FROM f) THEN 1 ELSE 0 END AS code FROM f)"


@query("demo_binary_encode", "dm", CODES + " SELECT participant_id, code AS SEX FROM dm JOIN codes ON lower(SEX) = value")
def demo_binary_encode(spark, sf_dir):
    d = X.demographics(spark, sf_dir)
    return D.encode(d, "SEX", D.encoding(d, "SEX", "row_ordinal")).select("participant_id", "SEX")


@query("demo_binary_apply_ref", "dm", CODES + " SELECT participant_id, coalesce(code, 0) AS SEX FROM (SELECT participant_id, CASE WHEN participant_id % 4 = 0 THEN 'other' ELSE upper(SEX) END AS s FROM dm) LEFT JOIN codes ON lower(s) = value")
def demo_binary_apply_ref(spark, sf_dir):
    d = X.demographics(spark, sf_dir)
    others = d.withColumn("SEX", F.when(F.col("participant_id") % 4 == 0, "other").otherwise(F.upper("SEX")))
    return D.encode(others, "SEX", D.encoding(d, "SEX", "row_ordinal")).select("participant_id", "SEX")


@query("demo_binary_decode", "dm", "SELECT participant_id, lower(SEX) AS SEX FROM dm")
def demo_binary_decode(spark, sf_dir):
    d = X.demographics(spark, sf_dir)
    codes = D.encoding(d, "SEX", "row_ordinal")
    return D.decode(D.encode(d, "SEX", codes), "SEX", codes).select("participant_id", "SEX")


def _raw_ids(spark, sf_dir):
    c = F.col("c_custkey")
    pid = F.when(c % 4 == 0, F.concat(F.lit("sub-"), c.cast("string"))).when(c % 4 == 1, c.cast("string")).when(c % 4 == 2, F.concat(F.lit(" "), c.cast("string"))).otherwise(F.concat(F.lit("Sub"), c.cast("string")))
    ses = F.when(c % 5 == 0, "ses-01").when(c % 5 == 1, "02").when(c % 5 == 2, "n/a").when(c % 5 == 3, "")
    return X.table(spark, sf_dir, "customer").select(c.alias("id"), pid.alias("pid"), ses.alias("ses"))


RAW = "raw AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'sub-' || c_custkey WHEN 1 THEN '' || c_custkey WHEN 2 THEN ' ' || c_custkey ELSE 'Sub' || c_custkey END AS pid, CASE c_custkey % 5 WHEN 0 THEN 'ses-01' WHEN 1 THEN '02' WHEN 2 THEN 'n/a' WHEN 3 THEN '' END AS ses FROM customer)"


@query("id_validate", None, f"WITH {RAW} SELECT id, pid, ses FROM raw WHERE NOT (regexp_matches(pid, '^sub-.+') AND (ses IS NULL OR regexp_matches(ses, '^ses-.+')))")
def id_validate(spark, sf_dir):
    return _raw_ids(spark, sf_dir).where(~names.valid_id(F.col("pid"), F.col("ses")))


@query("id_normalise", None, f"WITH {RAW}, b AS (SELECT id, 'sub-' || regexp_replace(trim(pid), '^sub-', '') AS p, CASE WHEN ses IS NULL OR ses IN ('', 'n/a') THEN NULL ELSE 'ses-' || regexp_replace(ses, '^ses-', '') END AS s FROM raw) SELECT id, p AS participant_id, s AS session_id, concat_ws('_', p, s) AS bids_id FROM b")
def id_normalise(spark, sf_dir):
    return _raw_ids(spark, sf_dir).select("id", names.participant(F.col("pid")).alias("participant_id"), names.session(F.col("ses")).alias("session_id"), names.bids_id(F.col("pid"), F.col("ses")).alias("bids_id"))


# Feature tokens that the parts' keys stand for.
TOKENS = ["fa", "ADC", "Thickness", "flair", "T1map", "QT1*Blur", "FMRI", "plugin_x", "flair*BLUR"]


def _tokens(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(t) for t in TOKENS]), (F.col("p_partkey") % len(TOKENS) + 1).cast("int")).alias("token"), F.when(F.col("p_size") % 2 == 0, "cortex").otherwise("subcortical").alias("structure"))


TOK = "tok AS (SELECT p_partkey, ([" + ", ".join(f"'{t}'" for t in TOKENS) + f"])[p_partkey % {len(TOKENS)} + 1] AS token, CASE WHEN p_size % 2 = 0 THEN 'cortex' ELSE 'subcortical' END AS structure FROM part)"
CANON = "CASE lower(token) WHEN 'fa' THEN 'FA' WHEN 'adc' THEN 'ADC' WHEN 'thickness' THEN 'thickness' WHEN 'flair' THEN 'FLAIR' WHEN 't1map' THEN 'qT1' WHEN 'qt1*blur' THEN 'qT1*blur' WHEN 'flair*blur' THEN 'FLAIR*blur' WHEN 'fmri' THEN 'fMRI' ELSE token END"


@query("feature_canon", None, f"WITH {TOK} SELECT p_partkey, CASE WHEN {CANON} = 'thickness' AND structure = 'subcortical' THEN 'volume' ELSE {CANON} END AS feature FROM tok")
def feature_canon(spark, sf_dir):
    return _tokens(spark, sf_dir).select("p_partkey", names.for_structure(names.canonical_feature(F.col("token")), F.col("structure")).alias("feature"))


@query("feature_expand", None, f"WITH {TOK} SELECT p_partkey, unnest(CASE WHEN {CANON} = 'fMRI' THEN ['rmssd', 'timescales', 'alff', 'falff'] ELSE [{CANON}] END) AS feature FROM tok WHERE {CANON} <> 'FA'")
def feature_expand(spark, sf_dir):
    """Report features: one is dropped, the time-series group becomes its four members."""
    feature = names.canonical_feature(F.col("token"))
    several = F.when(F.col("feature") == "fMRI", F.array(*[F.lit(x) for x in names.SERIES_FEATURES])).otherwise(F.array("feature"))
    return _tokens(spark, sf_dir).select("p_partkey", feature.alias("feature")).where("feature <> 'FA'").select("p_partkey", F.explode(several).alias("feature"))


@query("feature_applicability", None, f"WITH {TOK}, l AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'white' ELSE 'midthickness' END AS label, {CANON} AS feature FROM tok) SELECT p_partkey, feature, structure, label, NOT (feature LIKE '%*blur' OR feature = 'fMRI') OR (structure = 'cortex' AND label = 'midthickness') AS applicable FROM l")
def feature_applicability(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("feature", names.canonical_feature(F.col("token"))).withColumn("label", F.when(F.col("p_partkey") % 3 == 0, "white").otherwise("midthickness"))
    return t.select("p_partkey", "feature", "structure", "label", names.applicable(F.col("feature"), F.col("structure"), F.col("label")).alias("applicable"))


@query("cohort_summary", "dm", "SELECT count(*) AS n, round(avg(AGE), 6) + 0.0 AS mean_age, round(stddev_samp(AGE), 6) + 0.0 AS sd_age, count(*) FILTER (SEX = 'M') AS n_male, count(*) FILTER (SEX = 'F') AS n_female, round(100.0 * count(*) FILTER (SEX = 'M') / count(*), 6) + 0.0 AS percent_male, round(100.0 * count(*) FILTER (SEX = 'F') / count(*), 6) + 0.0 AS percent_female FROM dm")
def cohort_summary(spark, sf_dir):
    out = D.cohort_summary(X.demographics(spark, sf_dir), "AGE", "SEX")
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_age", "sd_age", "percent_male", "percent_female")})


@query("age_histogram", "dm", ", e AS (SELECT CAST(floor(min(AGE) / 5) * 5 AS INTEGER) AS lo, max(AGE) AS hi FROM dm), b AS (SELECT CAST(greatest(lo, ceil(AGE / 5) * 5 - 5) AS INTEGER) AS bin, SEX FROM dm, e), s AS (SELECT unnest(range(lo, CAST(greatest(lo, ceil(hi / 5) * 5 - 5) AS INTEGER) + 1, 5)) AS bin FROM e) SELECT CAST(s.bin AS INTEGER) AS bin, s.bin || '-' || (s.bin + 4) AS label, count(*) FILTER (SEX = 'F') AS n_female, count(*) FILTER (SEX = 'M') AS n_male FROM s LEFT JOIN b USING (bin) GROUP BY s.bin")
def age_histogram(spark, sf_dir):
    return D.age_histogram(X.demographics(spark, sf_dir), "AGE", "SEX")


def _grid(spark, sf_dir):
    expected = inventory.expected_grid(X.subjects(spark, sf_dir), X.patterns(spark, sf_dir))
    return inventory.presence(expected, X.present(spark, sf_dir), ["subject", "feature", "structure"])


@query("grid", "pat", "SELECT feature, structure FROM pat")
def grid(spark, sf_dir):
    return X.patterns(spark, sf_dir)


@query("missing_files", "inv pat grid", "SELECT subject, feature, structure FROM grid WHERE NOT present")
def missing_files(spark, sf_dir):
    expected = inventory.expected_grid(X.subjects(spark, sf_dir), X.patterns(spark, sf_dir))
    return inventory.missing(expected, X.present(spark, sf_dir), ["subject", "feature", "structure"]).select("subject", "feature", "structure")


@query("missing_topk", "inv pat grid", ", m AS (SELECT subject, feature, structure, row_number() OVER (PARTITION BY subject ORDER BY feature, structure) AS rank, greatest(count(*) OVER (PARTITION BY subject) - 10, 0) AS more FROM grid WHERE NOT present) SELECT subject, feature, structure, CAST(rank AS INTEGER) AS rank, CAST(more AS BIGINT) AS more FROM m WHERE rank <= 10")
def missing_topk(spark, sf_dir):
    return inventory.first_missing(missing_files(spark, sf_dir), ["subject"], ["feature", "structure"])


@query("base_subjects", None, "SELECT c_custkey AS subject FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def base_subjects(spark, sf_dir):
    p = X.present(spark, sf_dir)
    return inventory.in_all(X.subjects(spark, sf_dir), [p.where("structure = 'F'"), p.where("structure = 'O'"), p.where("feature = '1-URGENT'")], ["subject"])


@query("output_validation", "inv pat grid", ", s AS (SELECT subject, feature, structure, bool_and(present) AS ok FROM grid GROUP BY ALL) SELECT subject, feature, bool_or(ok) AS valid_any, bool_and(ok) AS valid_all FROM s GROUP BY ALL")
def output_validation(spark, sf_dir):
    return inventory.validation(_grid(spark, sf_dir), ["subject"], "feature", "structure")


@query("validation_summary", "inv pat grid", ", e AS (SELECT subject, count(*) AS files, count(*) FILTER (present) AS found FROM grid GROUP BY subject), t AS (SELECT count(*) AS subjects, count(*) FILTER (files = found) AS complete, CAST(sum(files) AS BIGINT) AS files, CAST(sum(found) AS BIGINT) AS found FROM e) SELECT *, round(100.0 * complete / subjects, 6) + 0.0 AS complete_percent, round(100.0 * found / files, 6) + 0.0 AS found_percent, CASE WHEN complete = 0 THEN 'error' WHEN 100.0 * complete / subjects < 25 THEN 'warning' ELSE 'ok' END AS verdict FROM t")
def validation_summary(spark, sf_dir):
    out = inventory.validation_summary(_grid(spark, sf_dir), ["subject"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("complete_percent", "found_percent")})


@query("availability_grouping_sets", "inv pat grid", "SELECT feature, structure, count(DISTINCT subject) FILTER (present) AS n, round(100.0 * count(DISTINCT subject) FILTER (present) / (SELECT count(DISTINCT subject) FROM grid), 6) + 0.0 AS percent FROM grid GROUP BY GROUPING SETS ((feature), (feature, structure), (structure))")
def availability_grouping_sets(spark, sf_dir):
    return inventory.availability(_grid(spark, sf_dir), "feature", "structure", "subject").withColumn("percent", rounded(F.col("percent")))


@query("subject_completeness", "inv pat grid", "SELECT subject, count(*) FILTER (NOT present) AS n_missing, coalesce(string_agg(DISTINCT feature, ',' ORDER BY feature) FILTER (NOT present), '') AS missing_features FROM grid GROUP BY subject")
def subject_completeness(spark, sf_dir):
    return inventory.completeness(_grid(spark, sf_dir), ["subject"], "feature")


@query("feature_matrix", "inv pat grid", "SELECT feature, bool_or(present) FILTER (structure = 'F') AS F, bool_or(present) FILTER (structure = 'O') AS O, bool_or(present) FILTER (structure = 'P') AS P FROM grid GROUP BY feature")
def feature_matrix(spark, sf_dir):
    """Which features are there, for any subject, in which structure."""
    return inventory.feature_matrix(_grid(spark, sf_dir), "feature", "structure", ["F", "O", "P"])


@query("feature_set_check", "inv", ", a AS (SELECT DISTINCT feature FROM inv WHERE structure = 'P'), b AS (SELECT DISTINCT feature FROM inv WHERE feature <> '5-LOW') SELECT feature, 'first' AS only_in FROM a WHERE feature NOT IN (SELECT feature FROM b) UNION ALL SELECT feature, 'second' FROM b WHERE feature NOT IN (SELECT feature FROM a)")
def feature_set_check(spark, sf_dir):
    p = X.present(spark, sf_dir)
    return inventory.same_features(p.where("structure = 'P'"), p.where("feature <> '5-LOW'"), "feature")


@query("valid_features", "inv", "SELECT subject, feature FROM (SELECT DISTINCT subject, feature FROM inv WHERE structure = 'F') WHERE feature IN ('1-URGENT', '2-HIGH')")
def valid_features(spark, sf_dir):
    """Requested features that a subject has in one structure."""
    p = X.present(spark, sf_dir)
    wanted = p.select("feature").distinct().where(F.col("feature").isin("1-URGENT", "2-HIGH"))
    return p.where("structure = 'F'").select("subject", "feature").distinct().join(wanted, "feature", "left_semi").select("subject", "feature")


@query("report_combinations", "inv", ", s AS (SELECT DISTINCT feature, CASE WHEN structure = 'P' THEN 'asymmetry' ELSE 'regional' END AS analysis FROM inv) SELECT analysis, feature FROM (SELECT DISTINCT feature FROM inv), (VALUES ('regional'), ('asymmetry')) t(analysis) WHERE EXISTS (SELECT 1 FROM s WHERE s.feature = inv.feature AND s.analysis = t.analysis)".replace("FROM (SELECT DISTINCT feature FROM inv), ", "FROM (SELECT DISTINCT feature FROM inv) inv, "))
def report_combinations(spark, sf_dir):
    p = X.present(spark, sf_dir)
    scores = p.withColumn("analysis", F.when(F.col("structure") == "P", "asymmetry").otherwise("regional"))
    return inventory.combinations(scores, ["regional", "asymmetry"], p, "feature")


def _paths(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("out/"), names.map_path(sub=F.col("o_custkey").cast("string"), ses=F.lpad((F.col("o_orderkey") % 3).cast("string"), 2, "0"), hemi=F.when(F.col("o_orderkey") % 2 == 0, "L").otherwise("R"), label=F.lit("midthickness"), feature=F.concat(F.lit("f"), F.substring("o_orderpriority", 1, 1)), analysis=F.when(F.col("o_orderstatus") == "F", "regional").otherwise("asymmetry")), F.lit(".func.gii")).alias("path"))


@query("inventory_entities", None, "SELECT o_orderkey, '' || o_custkey AS sub, lpad('' || (o_orderkey % 3), 2, '0') AS ses, CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END AS hemi, 'f' || substr(o_orderpriority, 1, 1) AS feature, CASE WHEN o_orderstatus = 'F' THEN 'regional' ELSE 'asymmetry' END AS analysis, CAST(NULL AS VARCHAR) AS smooth FROM orders")
def inventory_entities(spark, sf_dir):
    return maps.with_entities(_paths(spark, sf_dir), ("sub", "ses", "hemi", "feature", "analysis", "smooth")).drop("path")


@query("layout_detect", None, "SELECT coalesce(arg_min(v, o), 1) AS version FROM (SELECT CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 END AS v, o_orderkey AS o FROM orders) WHERE v IS NOT NULL")
def layout_detect(spark, sf_dir):
    return inventory.layout_version(X.table(spark, sf_dir, "orders"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "F", 1))


@query("ordered_dedupe", None, "SELECT o_custkey AS subject, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def ordered_dedupe(spark, sf_dir):
    return inventory.ordered_distinct(X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey"), ["subject"], "o_orderkey")


@query("run_status", "inv pat grid", ", s AS (SELECT subject, CASE WHEN count(*) FILTER (present) >= 5 THEN 'success' ELSE 'failed' END AS status FROM grid GROUP BY subject) SELECT status, count(*) AS n, min(subject) AS first FROM s GROUP BY status")
def run_status(spark, sf_dir):
    status = _grid(spark, sf_dir).groupBy("subject").agg(F.when(F.count_if("present") >= 5, "success").otherwise("failed").alias("status"))
    return inventory.run_status(status, "subject")


@query("subject_intersect", "inv", "SELECT subject FROM inv WHERE feature = '1-URGENT' INTERSECT SELECT subject FROM inv WHERE feature = '2-HIGH'")
def subject_intersect(spark, sf_dir):
    p = X.present(spark, sf_dir)
    return p.where("feature = '1-URGENT'").select("subject").intersect(p.where("feature = '2-HIGH'").select("subject"))
