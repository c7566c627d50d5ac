"""Measurement sources and sinks: packed or long Parquet maps, surface files, region tables and region text."""

from __future__ import annotations

import base64
import gzip
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.names import BLUR, entity

# Region labels of the statistics text and the names they are reported under, in report order.
REGION_LABELS = [26, 18, 11, 17, 13, 12, 10, 58, 54, 50, 53, 52, 51, 49]
REGION_NAMES = ["Laccumb", "Lamyg", "Lcaud", "Lhippo", "Lpal", "Lput", "Lthal", "Raccumb", "Ramyg", "Rcaud", "Rhippo", "Rpal", "Rput", "Rthal"]


def unpack(packed: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """(keys, vertex, value) of maps held as arrays; NaN stays NaN, values are computed on as doubles."""
    return packed.select(*keys, F.posexplode(values).alias("vertex", "value")).withColumn("value", F.col("value").cast("double"))


def joined_hemispheres(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values): the left map and then the right one as one array, in vertex order; subjects that lack a side are left
    out. An array is as long as two meshes."""
    packed = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("hemi", "vertex", "value"))).alias("v"), F.count_distinct("hemi").alias("n"))
    return packed.where("n = 2").select(*keys, F.transform("v", lambda x: x["value"]).alias("values"))


def loaded_subjects(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The subjects a scan really brought, for aligning demographics with data."""
    return maps.select(*keys).distinct()


_DTYPES = {"NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_FLOAT64": "f8"}


def decode_surface_file(content: bytes) -> list[tuple[str, np.ndarray]]:
    """(intent, array) of each data array of a surface file: a small XML reader for the encodings in common use."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    out = []
    for a in ElementTree.fromstring(content).iter("DataArray"):
        text = (a.findtext("Data") or "").strip()
        kind = np.dtype((">" if a.get("Endian") == "BigEndian" else "<") + _DTYPES[a.get("DataType", "")])
        if a.get("Encoding") == "ASCII":
            data = np.array(text.split(), kind)
        else:
            raw = base64.b64decode(text)
            data = np.frombuffer(zlib.decompress(raw) if a.get("Encoding") == "GZipBase64Binary" else raw, kind)
        shape = [int(a.get(f"Dim{i}")) for i in range(int(a.get("Dimensionality", "1")))]
        order = "F" if a.get("ArrayIndexingOrder") == "ColumnMajorOrder" else "C"
        out.append((a.get("Intent", ""), data.reshape(shape, order=order)))
    return out


def encode_surface_file(arrays: list[np.ndarray]) -> bytes:
    """A surface file of scalar maps, one array for each depth, as compressed doubles."""
    data = "".join(
        f'<DataArray Intent="NIFTI_INTENT_NONE" DataType="NIFTI_TYPE_FLOAT64" ArrayIndexingOrder="RowMajorOrder" Dimensionality="1" Dim0="{len(a)}" Encoding="GZipBase64Binary" Endian="LittleEndian">'
        f"<Data>{base64.b64encode(zlib.compress(np.asarray(a, '<f8').tobytes())).decode()}</Data></DataArray>"
        for a in arrays
    )
    return f'<?xml version="1.0" encoding="UTF-8"?><GIFTI Version="1.0" NumberOfDataArrays="{len(arrays)}">{data}</GIFTI>'.encode()


def read_surface_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(maps, errors): scalar maps of surface files, one array for each depth, and the files that could not be read.

    Files are read by Spark's binaryFile source and decoded in Arrow batches; a bad file is a row, not a failed job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gii*").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    arrays = [d for intent, d in decode_surface_file(content) if intent not in ("NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE")]
                    rows += [(file, depth, d.astype(float).ravel().tolist(), None) for depth, d in enumerate(arrays)]
                except Exception as problem:  # noqa: BLE001  reported as a row
                    rows.append((file, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=["path", "depth", "values", "error"]).astype({"depth": "Int32"})

    read = files.mapInPandas(decode, "path string, depth int, values array<double>, error string")
    return read.where("error is null").drop("error"), read.where("error is not null").select("path", "error")


def with_entities(paths: DataFrame, names: tuple[str, ...], column: str = "path") -> DataFrame:
    return paths.withColumns({n: entity(F.col(column), n) for n in names})


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def region_statistics(lines: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """Wide region volumes from whitespace text: comment lines go, columns 2, 4 and 5 are label, volume and name; the 14
    labels above become columns."""
    parts = F.split(F.trim(column), r"\s+")
    known = F.create_map(*[F.lit(x) for pair in zip(REGION_LABELS, REGION_NAMES, strict=True) for x in pair])
    rows = lines.where(~F.ltrim(F.col(column)).startswith("#") & (F.trim(column) != "")).select(*keys, known[F.get(parts, F.lit(1)).try_cast("int")].alias("region"), F.get(parts, F.lit(3)).try_cast("double").alias("volume"))
    return region_wide(rows.where("region is not null").withColumnRenamed("volume", "value"), keys, REGION_NAMES)


def region_wide(long: DataFrame, keys: list[str], regions: list[str], region: str = "region") -> DataFrame:
    return long.groupBy(*keys).pivot(region, regions).agg(F.first("value"))


def region_long(wide: DataFrame, keys: list[str], drop: tuple[str, ...] = ("structure", "SubjID")) -> DataFrame:
    """(keys, region, value) of all other columns but the metadata ones; regions a subject lacks are left out."""
    regions = [c for c in wide.columns if c not in keys and c not in drop]
    return wide.select(*keys, *[F.col(c).cast("double").alias(c) for c in regions]).unpivot(keys, regions, "region", "value").where("value is not null")


def union_wide(frames: list[DataFrame]) -> DataFrame:
    """Rows of region tables with different columns; a column a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as float32, partitioned by what reports select on; only the partitions at hand are replaced."""
    out = scores.withColumn("score", F.col("score").cast("float"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "structure", "feature", "analysis").parquet(path)


def write_region_scores(scores: DataFrame, keys: list[str], regions: list[str], path: str) -> None:
    region_wide(scores.withColumnRenamed("score", "value"), keys, regions).write.mode("overwrite").option("header", True).csv(path)


def feature_label(features: list[str]) -> str:
    """The name a score over several features is saved under; blurred features are left out."""
    return "-".join(f for f in features if BLUR not in f)
