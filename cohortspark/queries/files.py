"""Files: surface maps through the data source, inventories, region text and saved scores, from tables that Spark writes first."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortspark import fixtures as X
from cohortspark.functions.scores import rounded
from cohortspark.operators import normative
from cohortspark.queries.scores import S
from cohortspark.sources import demographics as D
from cohortspark.sources import mapfiles, maps

QUERIES, ORACLES = {}, {}


def query(name: str, views: str | None, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, X.with_views(views, sql) if views else sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; one machine has a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="maps-")
    return f"{root.removeprefix('file://')}/maps-{uuid.uuid4().hex}"


def _study(spark: SparkSession, sf_dir: str) -> str:
    """A folder of surface files, one for each vector and side, as a processing run leaves them."""
    root = shared_folder(spark)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vec, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                folder = f"{root}/sub-{vec}/ses-{vec % 2 + 1:02d}/maps/cortex"
                os.makedirs(folder, exist_ok=True)
                for hemi, side in (("L", values[:32]), ("R", values[32:])):
                    path = f"{folder}/sub-{vec}_ses-{vec % 2 + 1:02d}_hemi-{hemi}_surf-fsLR-5k_label-midthickness_feature-FA.func.gii"
                    with open(f"{path}.{uuid.uuid4().hex}", "wb") as file:  # an attempt that is repeated leaves whole files
                        file.write(maps.encode_surface_file([np.array(side)]))
                    os.replace(file.name, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return root


@query("map_files", "e", "SELECT 'sub-' || participant_id AS participant_id, 'ses-0' || (participant_id % 2 + 1) AS session_id, hemi, 'FA' AS feature, 'midthickness' AS label, CAST(vertex AS BIGINT) AS vertex, round(value, 6) + 0.0 AS value FROM e WHERE hemi = 'R'")
def map_files(spark, sf_dir):
    """Maps of one side, of all subjects, read from files; those of the other side are not opened."""
    read = mapfiles.read_maps(spark, _study(spark, sf_dir)).where("hemi = 'R' and feature in ('FA', 'ADC') and error is null")
    long = maps.unpack(read, ["participant_id", "session_id", "hemi", "feature", "label"])
    return long.withColumns({"vertex": F.col("vertex").cast("bigint"), "value": rounded(F.col("value"))})


@query("map_inventory", "e", "SELECT DISTINCT 'sub-' || participant_id AS participant_id, 'ses-0' || (participant_id % 2 + 1) AS session_id, hemi, 'FA' AS feature FROM e")
def map_inventory(spark, sf_dir):
    """Files below a folder by what their names say; no content is read."""
    named = maps.with_entities(maps.inventory(spark, _study(spark, sf_dir)), ("sub", "ses", "hemi", "feature"))
    return named.select(F.concat(F.lit("sub-"), "sub").alias("participant_id"), F.concat(F.lit("ses-"), "ses").alias("session_id"), "hemi", "feature")


_LABELS = {f"{side}{n + 1}": label for side, labels in (("F", maps.REGION_LABELS[:7]), ("O", maps.REGION_LABELS[7:])) for n, label in enumerate(labels)}
_NAMES = dict(zip(maps.REGION_LABELS, maps.REGION_NAMES, strict=True))


@query("region_text", None, "SELECT l_suppkey AS participant_id, " + ", ".join(f"round(sum(l_quantity) FILTER (l_linestatus = '{k[0]}' AND l_linenumber = {k[1:]}), 4) + 0.0 AS {_NAMES[v]}" for k, v in _LABELS.items()) + " FROM lineitem GROUP BY l_suppkey")
def region_text(spark, sf_dir):
    """Region volumes parsed from the lines of a statistics text, with comments, blanks and a label that is not asked for."""
    label = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])[F.concat("l_linestatus", F.col("l_linenumber").cast("string"))]
    volumes = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("participant_id"), label.alias("label")).agg(F.sum("l_quantity").alias("volume"))
    line = F.format_string("  %d  %d   1000 %s region-%d  0.5", F.col("label") % 5, F.col("label"), F.col("volume").cast("string"), F.col("label"))
    lines = F.explode(F.array(F.lit("# Measure volume, in mm^3"), line, F.lit("1 99999 10 7.5 other"), F.lit("")))
    wide = maps.region_statistics(volumes.select("participant_id", lines.alias("value")), ["participant_id"])
    return wide.select("participant_id", *[rounded(F.col(c), 4).alias(c) for c in maps.REGION_NAMES])


@query("scores_saved", "e", S + " SELECT participant_id, hemi, CAST(vertex AS BIGINT) AS vertex, 'zscore' AS method, 'cortex' AS structure, 'FA' AS feature, 'regional' AS analysis, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 3) + 0.0 AS score FROM s")
def scores_saved(spark, sf_dir):
    """Scores as they are saved, single precision and partitioned, read again; saving them twice leaves them once."""
    path = shared_folder(spark)
    e = X.surface_maps(spark, sf_dir)
    scores = normative.zscore(e.where("cohort = 'control'"), e.where("cohort = 'patient'"), ["hemi", "vertex"]).withColumns({c: F.lit(v) for c, v in (("method", "zscore"), ("structure", "cortex"), ("feature", "FA"), ("analysis", "regional"))})
    for _ in range(2):
        maps.write_scores(scores, path)
    read = spark.read.parquet(path)
    return read.withColumns({"vertex": F.col("vertex").cast("bigint"), "score": rounded(F.col("score").cast("double"), 3)})


@query("patient_lookup", "dm", "SELECT participant_id, AGE, SEX FROM dm WHERE participant_id = (SELECT max(participant_id) FROM dm)")
def patient_lookup(spark, sf_dir):
    """The demographics row of one patient, the one with the greatest id."""
    dm = X.demographics(spark, sf_dir)
    return D.lookup(dm, dm.agg(F.max("participant_id")).first()[0]).select("participant_id", "AGE", "SEX")


@query("hemispheres_joined", "e", "SELECT participant_id, CAST((CASE WHEN hemi = 'L' THEN 0 ELSE 32 END) + vertex AS BIGINT) AS place, round(value, 6) + 0.0 AS value FROM e WHERE participant_id % 7 <> 0")
def hemispheres_joined(spark, sf_dir):
    """Left then right map of each subject as one array, for subjects that have both, and its places."""
    e = X.surface_maps(spark, sf_dir).where("hemi = 'L' or participant_id % 7 <> 0")
    return maps.unpack(maps.joined_hemispheres(e, ["participant_id"]), ["participant_id"]).select("participant_id", F.col("vertex").cast("bigint").alias("place"), rounded(F.col("value")).alias("value"))
