"""Time-series features of long (series keys, t, value) tables; t numbers a series' points from 0.

Series spread over the cluster, and so do the parts of a long one: autocorrelations are summed over pairs of blocks, and
Fourier transforms of long series take two passes over lines of a square instead of one over the series. No task holds
more than a block, a line or a short series. Packed series go through Arrow in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TR, LOW, HIGH = 0.65, 0.01, 0.08
#: Points in a block of an autocorrelation; points up to which a transform is worked on as a whole.
BLOCK, WHOLE = 4096, 1 << 16


def rmssd(series: DataFrame, keys: list[str]) -> DataFrame:
    """sqrt(sum of squared differences) / (n - 1); one point gives NaN."""
    step = series.withColumn("d", F.col("value") - F.lag("value").over(W.partitionBy(*keys).orderBy("t")))
    n = F.count("*")
    return step.groupBy(*keys).agg(F.when(n > 1, F.sqrt(F.sum(F.col("d") * F.col("d"))) / F.when(n > 1, n - 1)).otherwise(F.lit(float("nan"))).alias("rmssd"))


def detrend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Values with each series' least-squares line taken off; one point has nothing left."""
    line = series.groupBy(*keys).agg(F.regr_slope("value", "t").alias("b"), F.avg("value").alias("my"), F.avg("t").alias("mt"))
    return series.join(line, keys).select(*keys, "t", (F.col("value") - F.col("my") - F.coalesce("b", F.lit(0.0)) * (F.col("t") - F.col("mt"))).alias("value"))


def acf(series: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, lag, acf): raw autocorrelation over lag 0's, which is left as it is where it is 0.

    A series is cut in blocks. Each pair of blocks gives its products' sums for the lags between them, in one array; these are
    added up by lag. A pair is a row of its own, so the n^2 / 2 products of a long series spread over the cluster."""
    rows = series.select(*keys, "t", F.col("value").cast("double").alias("value")).withColumn("b", F.floor(F.col("t") / block).cast("int"))
    cut = rows.groupBy(*keys, "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("x"))
    last = rows.groupBy(*keys).agg(F.max("b").alias("last"))
    own = cut.select(*keys, F.lit(0).alias("d"), "x", F.col("x").alias("y"))
    more = cut.join(last.where("last > 0"), keys)
    low = more.where("b < last").select(*keys, F.col("b").alias("low"), F.explode(F.sequence(F.lit(1), F.col("last") - F.col("b"))).alias("d"), "x")
    high = more.where("b > 0").select(*keys, F.explode(F.sequence(F.lit(1), F.col("b"))).alias("d"), F.col("x").alias("y"), "b").withColumn("low", F.col("b") - F.col("d")).drop("b")
    pairs = own.unionByName(low.join(high, [*keys, "low", "d"]).select(*keys, "d", "x", "y"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            sums = [np.correlate(b, a, "full") for a, b in zip(x, y, strict=True)]
            at = [int(d) * block - len(a) + 1 for d, a in zip(batch.column("d").to_numpy(), x, strict=True)]
            first = [max(0, f) for f in at]  # a block with itself has every lag twice
            out = pa.array([c[f - b :] for c, f, b in zip(sums, first, at, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(first, pa.int64()), out], [*keys, "first", "sums"])

    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    parts = pairs.mapInArrow(products, f"{kinds}, first long, sums array<double>")
    c = parts.select(*keys, "first", F.posexplode("sums").alias("_nth", "_sum")).groupBy(*keys, (F.col("first") + F.col("_nth")).alias("lag")).agg(F.sum("_sum").alias("c"))
    zero = F.first("c").over(W.partitionBy(*keys).orderBy("lag").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return c.withColumn("z", zero).select(*keys, "lag", F.when(F.col("z") != 0, F.col("c") / F.when(F.col("z") != 0, F.col("z"))).otherwise(F.col("c")).alias("acf"))


def timescale(series: DataFrame, keys: list[str], tr: float = TR) -> DataFrame:
    """tr times the sum of the autocorrelation at lags from 1 to before the first that is negative or NaN."""
    lags = acf(series, keys).where("lag >= 1")
    stops = F.when((F.col("acf") < 0) | F.isnan("acf"), 1).otherwise(0)
    lags = lags.withColumn("over", F.sum(stops).over(W.partitionBy(*keys).orderBy("lag")))
    sums = lags.groupBy(*keys).agg((tr * F.coalesce(F.sum(F.when(F.col("over") == 0, F.col("acf"))), F.lit(0.0))).alias("timescale"))
    return series.select(*keys).distinct().join(sums, keys, "left").select(*keys, F.coalesce("timescale", F.lit(0.0)).alias("timescale"))


def _lines(rows: DataFrame, keys: list[str], line: Column, order: Column, turn: Column) -> DataFrame:
    """Fourier transforms of the lines of (keys, n, n1, n2, re, im): a line's values in order, its result by place, each place
    turned by exp(-2 pi i turn place / n). (keys, n, n1, n2, line, place, re, im)."""
    held = [*keys, "n", "n1", "n2"]
    packed = rows.select(*held, line.alias("line"), order.alias("o"), "re", "im").groupBy(*held, "line").agg(F.sort_array(F.collect_list(F.struct("o", "re", "im"))).alias("v"))
    packed = packed.select(*held, "line", turn.alias("turn"), F.transform("v", lambda x: x["re"]).alias("re"), F.transform("v", lambda x: x["im"]).alias("im"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("re", "im"))
            n, turn = batch.column("n").to_numpy(), batch.column("turn").to_numpy()
            out = [np.fft.fft(a + 1j * b) * np.exp(-2j * np.pi * ((t * np.arange(len(a))) % size) / size) for a, b, size, t in zip(re, im, n, turn, strict=True)]
            parts = [pa.array([f(x) for x in out], pa.list_(pa.float64())) for f in (np.real, np.imag)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*held, "line"]], *parts], [*held, "line", "re", "im"])

    kinds = ", ".join(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in [*held, "line"])
    done = packed.mapInArrow(run, f"{kinds}, re array<double>, im array<double>")
    return done.select(*held, "line", F.posexplode(F.arrays_zip("re", "im")).alias("place", "v")).select(*held, "line", F.col("place").cast("long").alias("place"), "v.re", "v.im")


def _divisor(n: Column) -> Column:
    """The largest divisor of n up to its root."""
    return F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n))), lambda d: n % d == 0))


def _four_step(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, re, im) from (keys, n, n1, t, re, im), t from 0 to n - 1: the transform of n = n1 n2 points as transforms
    of n2 lines of n1 points, a turn of each point, and transforms of n1 lines of n2 points."""
    rows = rows.withColumn("n2", F.expr("n div n1"))
    first = _lines(rows, keys, F.col("t") % F.col("n2"), F.expr("t div n2"), F.col("line"))
    second = _lines(first.drop("t"), keys, F.col("place"), F.col("line"), F.lit(0).cast("long"))
    return second.select(*keys, (F.col("line") + F.col("n1") * F.col("place")).alias("k"), "re", "im")


def fourier(series: DataFrame, keys: list[str], whole: int = WHOLE) -> DataFrame:
    """(keys, k, re, im): the Fourier transform of each series, k from 0 to n - 1, in two grouped passes over lines of about
    sqrt(n) points.

    Where n has no divisor near its root, so that a line were longer than `whole`, the transform is a convolution with
    a chirp, by three transforms of a power of two."""
    sizes = series.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("n1", _divisor(F.col("n")))
    rows = series.join(sizes, keys).select(*keys, "n", "n1", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    even = _four_step(rows.where(F.expr(f"n div n1 <= {whole}")), keys)
    prime, odd = sizes.where(F.expr(f"n div n1 > {whole}")), rows.where(F.expr(f"n div n1 > {whole}"))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    side = F.pow(F.lit(2.0), F.floor(F.log2("m") / 2)).cast("long")
    angle = math.pi * F.expr("(t * t) % (2 * n)") / F.col("n")  # of the chirp exp(-i angle)
    prime = prime.select(*keys, "n", size.alias("m"))
    pad = prime.select(*keys, "n", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("t"))

    def transform(x: DataFrame) -> DataFrame:
        return _four_step(x.select(*keys, F.col("m").alias("n"), side.alias("n1"), "t", "re", "im"), keys)

    turned = odd.select(*keys, "t", (F.col("re") * F.cos(angle)).alias("re"), (-F.col("re") * F.sin(angle)).alias("im"))
    a = transform(pad.join(turned, [*keys, "t"], "left").select(*keys, "m", "t", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im")))
    back = pad.select(*keys, "n", "m", "t", F.least("t", F.col("m") - F.col("t")).alias("u")).where("u < n").withColumn("angle", math.pi * F.expr("(u * u) % (2 * n)") / F.col("n"))
    chirp = pad.select(*keys, "m", "t").join(back.select(*keys, "t", F.cos("angle").alias("re"), F.sin("angle").alias("im")), [*keys, "t"], "left")
    b = transform(chirp.select(*keys, "m", "t", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im")))
    product = a.join(b.withColumnsRenamed({"re": "br", "im": "bi"}), [*keys, "k"]).join(prime, keys)
    # the transform back is that of the conjugate, conjugated
    c = product.select(*keys, "m", F.col("k").alias("t"), F.expr("re * br - im * bi").alias("re"), F.expr("-(re * bi + im * br)").alias("im"))
    y = transform(c).join(prime, keys).where("k < n").select(*keys, "n", "m", F.col("k").alias("t"), (F.col("re") / F.col("m")).alias("re"), (-F.col("im") / F.col("m")).alias("im"))
    x = y.withColumn("angle", angle).select(*keys, F.col("t").alias("k"), F.expr("re * cos(angle) + im * sin(angle)").alias("re"), F.expr("im * cos(angle) - re * sin(angle)").alias("im"))
    return even.unionByName(x)


def _band(a: np.ndarray, n: int, tr: float, low: float, high: float) -> tuple[float, float]:
    f = np.arange(len(a)) / (n * tr)
    band, total = float(a[(f >= low) & (f <= high)].sum()), float(a.sum())
    return band, band / total if total > 0 else float("nan")


def alff(series: DataFrame, keys: list[str], tr: float = TR, low: float = LOW, high: float = HIGH, whole: int = WHOLE) -> DataFrame:
    """(keys, alff, falff): amplitudes of the detrended series' one-sided spectrum summed over the band, and their share
    of all amplitudes (NaN if those are 0). Series of over `whole` points are transformed in two passes, the others one by one."""
    flat = detrend(series, keys)
    sizes = series.groupBy(*keys).agg(F.count("*").alias("n"))

    def run(column: pd.Series) -> pd.DataFrame:
        rows = [_band(np.abs(np.fft.rfft(np.asarray(x, float))), len(x), tr, low, high) for x in column]
        return pd.DataFrame(rows, columns=["alff", "falff"])

    short = flat.join(sizes.where(f"n <= {whole}").drop("n"), keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("x"))
    done = short.select(*keys, F.pandas_udf(run, "alff double, falff double")("x").alias("f")).select(*keys, "f.alff", "f.falff")
    nan = F.lit(float("nan"))  # pandas hands NaN over as null
    done = done.select(*keys, F.coalesce("alff", nan).alias("alff"), F.coalesce("falff", nan).alias("falff"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= whole:
        return done
    long = sizes.where(f"n > {whole}")
    spectrum = fourier(flat.join(long.drop("n"), keys), keys).join(long, keys).where("2 * k <= n")
    spectrum = spectrum.select(*keys, F.sqrt(F.expr("re * re + im * im")).alias("a"), (F.col("k") / (F.col("n") * tr)).alias("f"))
    total = spectrum.groupBy(*keys).agg(F.sum("a").alias("all"), F.coalesce(F.sum(F.when(F.col("f").between(low, high), F.col("a"))), F.lit(0.0)).alias("alff"))
    return done.unionByName(total.select(*keys, "alff", F.when(F.col("all") > 0, F.col("alff") / F.when(F.col("all") > 0, F.col("all"))).otherwise(nan).alias("falff")))


def features(series: DataFrame, keys: list[str], tr: float = TR, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(keys, rmssd, timescale, alff, falff)."""
    return rmssd(series, keys).join(timescale(series, keys, tr), keys).join(alff(series, keys, tr, low, high), keys)


def packed_features(packed: DataFrame, keys: list[str], values: str = "values", tr: float = TR, low: float = LOW, high: float = HIGH) -> DataFrame:
    """The same four features of series held as arrays, in one Arrow pass: for series too long for lag tables."""

    def one(x: np.ndarray) -> tuple[float, float, float, float]:
        n = len(x)
        r = float(np.sqrt((np.diff(x) ** 2).sum()) / (n - 1)) if n > 1 else float("nan")
        zero, scale = float(x @ x), 0.0
        for lag in range(1, n):  # up to the first negative one: a few, for most series
            c = float(x[:-lag] @ x[lag:])
            c = c / zero if zero != 0 else c
            if not c >= 0:
                break
            scale += c
        t = np.arange(n)
        flat = x - np.polyval(np.polyfit(t, x, 1), t) if n > 1 else x - x
        return r, tr * scale, *_band(np.abs(np.fft.rfft(flat)), n, tr, low, high)

    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(np.asarray(x, float)) for x in column], columns=["rmssd", "timescale", "alff", "falff"])

    kind = "rmssd double, timescale double, alff double, falff double"
    out = packed.select(*keys, F.pandas_udf(run, kind)(F.col(values)).alias("f"))
    nan = F.lit(float("nan"))  # pandas hands NaN over as null
    return out.select(*keys, *[F.coalesce(F.col(f"f.{c}"), nan).alias(c) for c in ("rmssd", "timescale", "alff", "falff")])
