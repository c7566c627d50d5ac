"""Shared DataFrame pieces of the text operators."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def bound_resources(spark: SparkSession) -> None:
    """Keep the Arrow batches that tasks exchange with Python workers small: rows hold whole texts. Operators run many
    queries one after another, so each one's shuffle files go when it is done: its result is written, nothing reads them again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's checkpoint folder; where none is set (tests, one machine), set one."""
    bound_resources(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def saved(frame: DataFrame, eager: bool = True) -> DataFrame:
    """The frame with its lineage cut: rows are written to the shared checkpoint folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager)


def written(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, as a Parquet table in the shared checkpoint folder: later reads take the columns they need."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


HOT_SHARE = 1000
FEW = 4096  # rows that one task takes, whatever their keys


def join_hot(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner", fits: str = "true") -> DataFrame:
    """Join on a key of which right has one row each, with the number of its rows in left as `weight`.

    Keys that hold over 1 / HOT_SHARE of left's `total` rows are fewer than HOT_SHARE: those whose row `fits` (rows with
    columns of any length need a bound of their bytes) are broadcast, so no task gets a hot key's rows; all others
    are joined by a shuffle. The weight column goes. A null key joins nothing. A left of few rows has no hot keys: one
    join instead of two with broadcasts keeps the driver's plans, threads and broadcasts few where rounds follow fast."""
    if total <= FEW:
        return left.join(right.drop(weight), on, how)
    is_hot = (F.col(weight) * HOT_SHARE > total) & F.expr(fits)
    hot, rest = F.broadcast(right.where(is_hot).drop(weight)), right.where(~is_hot).drop(weight)
    return left.join(hot, on).unionByName(left.join(hot.select(on), on, "left_anti").join(rest, on, how))


FILTER_BITS = 24


def key_filter(frame: DataFrame, column: str) -> np.ndarray:
    """A bitmap over the low bits of a column of 64-bit keys, as bytes: 2 MB whatever the input.

    It only saves work: keys that pass it are still joined, so a crowded filter costs time and no results."""
    place = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # Spark's buckets hold places 1 to 32768, 32769 to 65536, ...
    found = frame.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in found:
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.astype(np.int64) & ((1 << FILTER_BITS) - 1)
    return (bits[place >> 3] >> (place & 7) & 1).astype(bool)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, rows_per_class: int) -> DataFrame:
    """Documents with a label 0 or 1, about `rows_per_class` of each class, chosen by a hash of the id.

    Repeated label rows count once; ids labelled both ways and null ids are left out. The sample's
    size is bounded by the parameter, so its ids are broadcast and no document is shuffled."""
    one = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    )
    count = {r["_y"]: r["n"] for r in one.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("_y") == 1, F.lit(rows_per_class / max(1, count.get(1, 0)))).otherwise(rows_per_class / max(1, count.get(0, 0)))
    chosen = one.where(unit(F.col("_id")) < rate)
    return docs.join(F.broadcast(chosen), docs[doc_id] == chosen["_id"]).drop("_id")


def train_in_one_task(rows: DataFrame, train: Callable, schema: str = "model binary") -> bytes | None:
    """Run `train` over a sample of bounded size in one executor task and fetch the model it yields."""
    got = rows.repartition(1).mapInArrow(train, schema).collect()
    return bytes(got[0][0]) if got else None
