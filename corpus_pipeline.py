"""A training-data pipeline of five text operators, each stage on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortspark.llm import common, decontaminate, jaccard, langid, mixing, suffix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts without a letter (null and empty ones too) and texts of no clear language."""
    docs = docs.select(*COLUMNS)
    return langid.keep_identified(docs, langid.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group of similar texts the document with the smallest id stays; rows that repeat an
    id count as one document. Rows without an id and texts without words stay as they are."""
    docs = docs.select(*COLUMNS)
    groups = jaccard.similar(docs.select("doc_id", "text"))
    gone = groups.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that start at more than one place are cut out of the texts. Null texts stay null, empty
    ones empty; rows that repeat a text lose what they repeat, all of it if it is long enough."""
    cut = suffix.cut_repeats(docs.select(*COLUMNS, F.col("text").isNull().alias("no_text")), carry=("lang", "source", "no_text"))
    text = F.when(~F.col("extra.no_text"), F.col("kept"))
    return cut.select("doc_id", text.alias("text"), F.col("extra.lang").alias("lang"), F.col("extra.source").alias("source"), F.length(text).cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a benchmark item go. Null and empty texts stay; rows that
    repeat id and text go or stay together."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.search(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = found.select(F.col("id").alias("b_id"), F.col("h").alias("b_h")).distinct()
    return docs.join(bad, F.expr("doc_id <=> b_id and xxhash64(text) = b_h"), "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document with its text, and the copies and words that the mix takes of it.

    Null and empty texts have size 0 and are taken no words of; rows that repeat a document are drawn one by one."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD_RUN)).cast("long")
    key = F.xxhash64("doc_id", "source", "size")
    texts = docs.select("doc_id", "source", "text", size.alias("size")).withColumn("k", key).repartition("k")  # texts are shuffled once, here
    nth = F.row_number().over(W.partitionBy("k", "doc_id", "source", "size").orderBy(F.xxhash64("text"))).cast("long")
    drawn = mixing.mix(docs.select(*COLUMNS)).withColumn("m_k", key).withColumnsRenamed({"doc_id": "m_id", "source": "m_source", "size": "m_size", "nth": "m_nth"})
    both = texts.withColumn("nth", nth).join(drawn, F.expr("k = m_k and doc_id <=> m_id and source <=> m_source and size = m_size and nth = m_nth"))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "text")


STAGES = [
    ("language_id", identify),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL can't express the learned language model and the random draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again. A stage's folder goes
    when the next one is written; the last one stays, for the result is read from it."""
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            common.remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
