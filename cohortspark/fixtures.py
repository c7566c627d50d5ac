"""Stand-in views: the given tables seen as maps, demographics, regions, series, inventories, grids and meshes.

Each view is a DataFrame and, for checks, a SQL expression named in SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surface_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: (participant_id, cohort, hemi, vertex, value), 32 vertices a side."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("participant_id"), F.when(F.col("label") < 5, "control").otherwise("patient").alias("cohort"), F.posexplode("embedding").alias("pos", "v"))
    return long.select("participant_id", "cohort", F.when(F.col("pos") < 32, "L").otherwise("R").alias("hemi"), (F.col("pos") % 32).alias("vertex"), F.col("v").cast("double").alias("value"))


def layered_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ED: as E with 8 vertices of 4 depths."""
    return surface_maps(spark, sf_dir).select("participant_id", "cohort", "hemi", (F.col("vertex") % 8).alias("vertex"), F.floor(F.col("vertex") / 8).cast("int").alias("depth"), "value")


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM: (participant_id, row_ordinal, AGE, BALANCE, SEX, SITE)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"), F.col("c_custkey").alias("row_ordinal"), (18 + F.col("c_custkey") % 60).cast("int").alias("AGE"), F.col("c_acctbal").alias("BALANCE"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("SEX"), F.col("c_mktsegment").alias("SITE"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: (participant_id, cohort, region, value, AGE); region is L or R and a number."""
    side = F.when(F.col("l_linestatus") == "F", "L").otherwise("R")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("participant_id"), F.concat(side, F.col("l_linenumber").cast("string")).alias("region")).agg(F.avg("l_extendedprice").alias("value"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("participant_id"), F.col("s_acctbal").alias("AGE"))
    return grouped.join(supplier, "participant_id").withColumn("cohort", F.when(F.col("participant_id") % 3 != 0, "control").otherwise("patient"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS: (series_id, t, value)."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(by) - 1).alias("t"), "value")


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INV: (subject, feature, structure) triples that exist."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("structure")).distinct()


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("feature")).distinct().crossJoin(o.select(F.col("o_orderstatus").alias("structure")).distinct())  # 5 x 3


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRID: (i, j, k, value, label)."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((p % 10).cast("int").alias("i"), (F.floor(p / 10) % 10).cast("int").alias("j"), F.floor(p / 100).cast("int").alias("k"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("label"))


WIDTH = 20


def mesh_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MESH: (vertex, x, y, z, value): a regular sheet, WIDTH vertices wide, with a bumpy height; every seventh value is 0."""
    v = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(v.alias("vertex"), (v % WIDTH).cast("double").alias("x"), F.floor(v / WIDTH).cast("double").alias("y"), (F.col("p_size") / 50.0).alias("z"), F.when(v % 7 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("value"))


def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles in each cell of the sheet."""
    v = mesh_vertices(spark, sf_dir).select("vertex")
    corner = v.where(F.col("vertex") % WIDTH < WIDTH - 1).alias("c").join(v.select((F.col("vertex") - WIDTH - 1).alias("far")).hint("merge").alias("f"), F.col("c.vertex") == F.col("f.far")).select("vertex")
    a, b, c, d = F.col("vertex"), F.col("vertex") + 1, F.col("vertex") + WIDTH, F.col("vertex") + WIDTH + 1
    both = F.array(F.struct(a.alias("v0"), b.alias("v1"), c.alias("v2")), F.struct(b.alias("v0"), d.alias("v1"), c.alias("v2")))
    return corner.select(F.explode(both).alias("t")).select("t.v0", "t.v1", "t.v2")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, vertex, layer, x, y, z, value): seven layers of each order line's part, by line number.

    Hundredths are added up as whole numbers: sums up to 2^53 are exact and a mean doesn't depend on the order of rows. A layer
    with finer values takes the plain mean."""

    def mean(c):
        cents = F.round(F.col(c) * 100)
        total = F.sum(F.when(cents / 100 != F.col(c), F.lit(float("nan"))).otherwise(cents))
        return F.when(F.isnan(total), F.avg(c)).otherwise(total / (F.count(c) * 100))

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_suppkey").alias("subject_id"), (F.col("l_partkey") % 8).alias("vertex"), (F.col("l_linenumber") - 1).cast("int").alias("layer")).agg(mean("l_quantity").alias("x"), mean("l_discount").alias("y"), mean("l_tax").alias("z"), mean("l_extendedprice").alias("value"))


#: The same views in SQL; a check lists those it needs.
SQL = {
    "e": "e AS (SELECT vec_id AS participant_id, CASE WHEN label < 5 THEN 'control' ELSE 'patient' END AS cohort, CASE WHEN p <= 32 THEN 'L' ELSE 'R' END AS hemi, CAST((p - 1) % 32 AS INTEGER) AS vertex, CAST(embedding[p] AS DOUBLE) AS value FROM (SELECT *, generate_subscripts(embedding, 1) AS p FROM embeddings))",
    "ed": "ed AS (SELECT participant_id, cohort, hemi, vertex % 8 AS vertex, CAST(vertex // 8 AS INTEGER) AS depth, value FROM e)",
    "dm": "dm AS (SELECT c_custkey AS participant_id, c_custkey AS row_ordinal, CAST(18 + c_custkey % 60 AS INTEGER) AS AGE, c_acctbal AS BALANCE, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS SEX, c_mktsegment AS SITE FROM customer)",
    "r": "r AS (SELECT g.*, s_acctbal AS AGE, CASE WHEN participant_id % 3 <> 0 THEN 'control' ELSE 'patient' END AS cohort FROM (SELECT l_suppkey AS participant_id, CASE WHEN l_linestatus = 'F' THEN 'L' ELSE 'R' END || CAST(l_linenumber AS VARCHAR) AS region, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL) g JOIN supplier ON s_suppkey = participant_id)",
    "ts": "ts AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)",
    "inv": "inv AS (SELECT DISTINCT o_custkey AS subject, o_orderpriority AS feature, o_orderstatus AS structure FROM orders)",
    "pat": "pat AS (SELECT * FROM (SELECT DISTINCT o_orderpriority AS feature FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS structure FROM orders))",
    "grid": "grid AS (SELECT c_custkey AS subject, feature, structure, EXISTS (SELECT 1 FROM inv WHERE inv.subject = c_custkey AND inv.feature = pat.feature AND inv.structure = pat.structure) AS present FROM customer CROSS JOIN pat)",
    "vox": "vox AS (SELECT CAST(p_partkey % 10 AS INTEGER) AS i, CAST((p_partkey // 10) % 10 AS INTEGER) AS j, CAST(p_partkey // 100 AS INTEGER) AS k, p_retailprice AS value, p_size AS label FROM part)",
    "mv": "mv AS (SELECT p_partkey AS vertex, CAST(p_partkey % 20 AS DOUBLE) AS x, CAST(p_partkey // 20 AS DOUBLE) AS y, p_size / 50.0 AS z, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_retailprice END AS value FROM part)",
    "mt": "mt AS (SELECT vertex AS v0, vertex + 1 AS v1, vertex + 20 AS v2 FROM mv c WHERE vertex % 20 < 19 AND EXISTS (SELECT 1 FROM mv f WHERE f.vertex = c.vertex + 21) UNION ALL SELECT vertex + 1, vertex + 21, vertex + 20 FROM mv c WHERE vertex % 20 < 19 AND EXISTS (SELECT 1 FROM mv f WHERE f.vertex = c.vertex + 21))",
    "me": "me AS (SELECT DISTINCT a, b FROM (SELECT v0 AS a, v1 AS b FROM mt UNION ALL SELECT v1, v0 FROM mt UNION ALL SELECT v0, v2 FROM mt UNION ALL SELECT v2, v0 FROM mt UNION ALL SELECT v1, v2 FROM mt UNION ALL SELECT v2, v1 FROM mt))",
    "ly": "ly AS (SELECT l_suppkey AS subject_id, l_partkey % 8 AS vertex, CAST(l_linenumber - 1 AS INTEGER) AS layer, avg(l_quantity) AS x, avg(l_discount) AS y, avg(l_tax) AS z, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)",
}


def with_views(names: str, query: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + "\n" + query
