"""Stream-static scoring: patients' measurements stream in and are joined with a cohort model that was fitted before.

The join keeps no state, so there is no watermark to set: each micro-batch is scored by itself, in the same plan as the batch
query, and a restarted stream goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(patients: DataFrame, model: DataFrame, keys: list[str], subject: list[str] = ["participant_id"]) -> DataFrame:  # noqa: B006
    """(subject, keys, score) of a streaming (or static) long table against a z-score model with mean and std."""
    return patients.join(model.select(*keys, "mean", "std"), keys).select(*subject, *keys, ((F.col("value") - F.col("mean")) / F.col("std")).alias("score"))


def write_stream(scores: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    writer = scores.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
