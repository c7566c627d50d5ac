"""Demographics: loading, checks and encodings. Checks are aggregates or anti-joins; only their verdicts reach the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULT_NAMES = {"ID": "participant_id", "SES": "session_id"}


def rename(frame: DataFrame, mapping: dict[str, str] = DEFAULT_NAMES) -> DataFrame:
    gone = [c for c in mapping if c not in frame.columns]
    if gone:
        raise ValueError(f"columns not found: {', '.join(gone)}")
    return frame.withColumnsRenamed(mapping)


def load(spark: SparkSession, path: str, mapping: dict[str, str] = DEFAULT_NAMES, schema: str | None = None) -> DataFrame:
    """A CSV file, or a tab-separated one by its suffix, with a header; fails if it is empty or lacks a mapped column."""
    reader = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
    frame = (reader.schema(schema) if schema else reader).csv(path)
    if frame.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rename(frame, mapping)


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables over the columns they share, tagged Dataset000, Dataset001, ..."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*common).withColumn("dataset", F.lit(f"Dataset{i:03d}")) for i, f in enumerate(frames)])


def subset(frame: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    return frame.join(pairs.select(*on).distinct(), on, "left_semi")


def subset_missing(frame: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    return pairs.select(*on).distinct().join(frame, on, "left_anti")


def lookup(frame: DataFrame, participant_id: str, session_id: str | None = None) -> DataFrame:
    out = frame.where(F.col("participant_id") == participant_id)
    return out.where(F.col("session_id") == session_id) if session_id else out


def null_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) for all columns in one pass."""
    one = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def not_integers(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values that differ from their whole part by more than 1e-8 + 1e-5 times it."""
    whole = F.col(column).cast("bigint")
    return frame.where(F.abs(F.col(column) - whole) > 1e-8 + 1e-5 * F.abs(whole)).select(F.col(column).alias("value")).distinct()


def not_floats(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNotNull() & F.col(column).try_cast("double").isNull()).select(F.col(column).cast("string").alias("value")).distinct()


def encoding(frame: DataFrame, column: str, order: str) -> DataFrame:
    """(value, code): of the lower-cased values the one seen first, by the order column, is 1 and the other 0."""
    low = frame.select(F.lower(F.col(column).cast("string")).alias("value"), F.col(order).alias("at")).where("value is not null")
    first = low.groupBy("value").agg(F.min("at").alias("at"))
    return first.crossJoin(first.agg(F.min("at").alias("earliest"))).select("value", F.when(F.col("at") == F.col("earliest"), 1).otherwise(0).alias("code"))


def encode(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The column as 0/1; values the encoding does not know are 0. Encodings have two rows."""
    known = F.broadcast(codes.select(F.col("value").alias("_v"), F.col("code").alias("_c")))
    return frame.join(known, F.lower(F.col(column).cast("string")) == F.col("_v"), "left").withColumn(column, F.coalesce("_c", F.lit(0))).drop("_v", "_c")


def decode(frame: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    known = F.broadcast(codes.select(F.col("value").alias("_v"), F.col("code").alias("_c")))
    return frame.join(known, F.col(column) == F.col("_c"), "left").withColumn(column, F.col("_v")).drop("_v", "_c")


def _metrics(columns: dict[str, str], order: str) -> list[Column]:
    """What the checks of all columns need to know, as aggregates of one row. Odd values are counted, with the least and the
    greatest as examples. For two-valued columns the values are numbered by a hash h: if all of them are the least or the
    greatest, the sum of (h - least) (h - greatest) is 0, and below 0 as soon as there is a third."""
    out = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(columns.items()):
        out.append(F.count_if(F.col(c).isNull()).alias(f"null{i}"))
        text = F.col(c).cast("string")
        if kind == "binary":
            low = F.lower(text)
            h = F.when(low.isNotNull(), F.shiftrightunsigned(F.xxhash64(low), 24)).cast("decimal(38,0)")
            out += [F.min(h).alias(f"least{i}"), F.max(h).alias(f"greatest{i}"), F.sum(h).alias(f"sum{i}"), F.sum((h * h).cast("decimal(38,0)")).alias(f"squares{i}"), F.count(h).alias(f"values{i}")]
            out += [F.min_by(low, h).alias(f"low{i}"), F.max_by(low, h).alias(f"high{i}"), F.min_by(low, F.when(low.isNotNull(), F.col(order))).alias(f"first{i}")]
        else:
            number = F.col(c).try_cast("double")
            odd = number.isNull()
            if kind == "int":
                whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
                odd = odd | ~(F.abs(number - whole) <= 1e-8 + 1e-5 * F.abs(whole))
            odd = F.when(F.col(c).isNotNull() & odd, text)
            out += [F.count(odd).alias(f"odd{i}"), F.min(odd).alias(f"from{i}"), F.max(odd).alias(f"to{i}")]
    return out


def validated(frame: DataFrame, columns: dict[str, str], order: str, reference: dict[str, DataFrame] | None = None, to: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Check and convert normative columns of declared type int, float or binary; returns the encodings used.

    All checks are observed during one pass over the table, which writes it to `to` if that is given (the result then reads it from
    there, as Parquet): one job for any number of columns. Nulls, values that are no numbers or not whole, and binary columns
    without exactly two values (case apart) are errors. Of two values the one seen first, by the order column, is 1. A
    reference's encoding is used wherever there is one, so patients are coded as the controls were."""
    for c, kind in columns.items():
        if c not in frame.columns:
            raise ValueError(f"column {c} not found")
        if kind not in ("int", "float", "binary"):
            raise ValueError(f"type {kind} of {c} is not int, float or binary")
    spark, seen = frame.sparkSession, Observation()
    watched = frame.observe(seen, *_metrics(columns, order)).write.mode("overwrite")
    watched.parquet(to) if to else watched.format("noop").save()
    m = seen.get
    if to:
        frame = spark.read.schema(frame.schema).parquet(to)
    nulls = [f"{c} ({m[f'null{i}']})" for i, c in enumerate(columns) if m[f"null{i}"]]
    if nulls:
        raise ValueError("null values in " + ", ".join(nulls))
    used = {}
    for i, (c, kind) in enumerate(columns.items()):
        if kind == "binary":
            codes = (reference or {}).get(c)
            if codes is None:
                least, greatest, total, squares = (int(m[f"{x}{i}"] or 0) for x in ("least", "greatest", "sum", "squares"))
                if least == greatest or squares - (least + greatest) * total + m[f"values{i}"] * least * greatest != 0:
                    raise ValueError(f"{c} does not have two values")
                codes = spark.createDataFrame([(v, int(v == m[f"first{i}"])) for v in (m[f"low{i}"], m[f"high{i}"])], "value string, code int")
            used[c] = codes
            frame = encode(frame, c, codes)
            continue
        if m[f"odd{i}"]:
            raise ValueError(f"{c} has {m[f'odd{i}']} values that are not {'integers' if kind == 'int' else 'numbers'}: {m[f'from{i}']} to {m[f'to{i}']}")
        number = F.col(c).cast("double")
        frame = frame.withColumn(c, number.cast("int") if kind == "int" else number)
    return frame, used


@dataclass
class Normative:
    """What a cohort's normative columns are: their declared types, and the codes of its binary ones."""

    columns: dict[str, str]
    codes: dict[str, DataFrame]


def normative(frame: DataFrame, order: str, columns: dict[str, str] | None = None, reference: Normative | None = None, to: str | None = None) -> tuple[DataFrame, Normative]:
    """`validated`, for cohorts that belong together: without columns of its own a cohort takes those of the reference, their
    types included, and it is always coded as the reference was. Neither: no column is normative."""
    inherited = columns if columns is not None else reference.columns if reference else {}
    if not inherited:
        return frame, Normative({}, {})
    out, codes = validated(frame, inherited, order, reference.codes if reference else None, to)
    return out, Normative(inherited, codes)


def cohort_summary(frame: DataFrame, age: str, sex: str) -> DataFrame:
    """One row: n, mean age, sample deviation, counts and percentages by sex."""
    n = F.count("*")
    count = lambda s: F.count_if(F.upper(F.col(sex)) == s)
    return frame.agg(n.alias("n"), F.avg(age).alias("mean_age"), F.stddev_samp(age).alias("sd_age"), count("M").alias("n_male"), count("F").alias("n_female"), (100.0 * count("M") / n).alias("percent_male"), (100.0 * count("F") / n).alias("percent_female"))


def age_bin(age: Column, least: Column) -> Column:
    """Lower edge of a right-closed bin of five years; the lowest bin holds its edge."""
    return F.greatest(F.floor(least / 5) * 5, F.ceil(age / 5) * 5 - 5).cast("int")


def own_age_bins(frame: DataFrame, subjects: DataFrame, age: str, sex: str, keys: list[str]) -> DataFrame:
    """(keys, bin, label, n_female, n_male, own): the histogram of `frame` for each of the subjects, their own bin flagged; an age
    outside of the histogram flags none. The histogram has a row for every five years, so it is broadcast."""
    least = frame.agg(F.min(age).alias("_lo"))  # one row
    placed = subjects.crossJoin(F.broadcast(least)).select(*keys, F.when(F.col(age) >= F.floor(F.col("_lo") / 5) * 5, age_bin(F.col(age), F.col("_lo"))).alias("_own"))
    return placed.crossJoin(F.broadcast(age_histogram(frame, age, sex))).select(*keys, "bin", "label", "n_female", "n_male", F.coalesce(F.col("bin") == F.col("_own"), F.lit(False)).alias("own"))


def age_histogram(frame: DataFrame, age: str, sex: str) -> DataFrame:
    """(bin, label, n_female, n_male) for every bin from the lowest to the highest, empty ones included."""
    ends = frame.agg(F.min(age).alias("lo"), F.max(age).alias("hi"))
    spine = ends.select(F.explode(F.sequence(age_bin(F.col("lo"), F.col("lo")), age_bin(F.col("hi"), F.col("lo")), F.lit(5))).alias("bin"))
    counts = frame.crossJoin(ends).groupBy(age_bin(F.col(age), F.col("lo")).alias("bin")).agg(F.count_if(F.col(sex) == "F").alias("n_female"), F.count_if(F.col(sex) == "M").alias("n_male"))
    return spine.join(counts, "bin", "left").select("bin", F.format_string("%d-%d", F.col("bin"), F.col("bin") + 4).alias("label"), F.coalesce("n_female", F.lit(0)).alias("n_female"), F.coalesce("n_male", F.lit(0)).alias("n_male"))
