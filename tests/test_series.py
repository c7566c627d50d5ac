"""Blocked autocorrelations and transforms in two passes against numpy."""

import math

import numpy as np
import pandas as pd
import pytest

from cohortspark.operators import series


def table(spark, data):
    parts = [pd.DataFrame({"s": k, "t": np.arange(len(x)), "value": x}) for k, x in data.items()]
    return spark.createDataFrame(pd.concat(parts)).repartition(4)


def plain_acf(x):
    c = np.correlate(x, x, "full")[len(x) - 1 :]
    return c / c[0] if c[0] != 0 else c


def test_acf_by_pairs_of_blocks(spark):
    r = np.random.default_rng(1)
    data = {"long": r.normal(size=5003).cumsum(), "even": r.normal(size=256), "short": r.normal(size=5), "one": np.array([3.0]), "zero": np.zeros(70), "last": r.normal(size=65)}
    rows = table(spark, data)
    for block in (64, series.BLOCK):
        got = series.acf(rows, ["s"], block=block).toPandas()
        for k, x in data.items():
            mine = got[got.s == k].sort_values("lag")
            assert mine.lag.tolist() == list(range(len(x)))
            assert np.allclose(mine.acf, plain_acf(x), atol=1e-12)


def test_timescale_stops_at_nan_and_at_negative(spark):
    data = {"nan": np.array([1.0, np.nan, 2.0]), "wave": np.array([1.0, 0.0, -1.0, 0.0, 1.0, 0.0, -1.0, 0.0]), "up": np.arange(1.0, 9)}
    rows = table(spark, data)
    want = {"nan": 0.0, "wave": 0.0, "up": series.TR * plain_acf(data["up"])[1:].sum()}
    packed = spark.createDataFrame([(k, x.tolist()) for k, x in data.items()], "s string, values array<double>")
    for got in (series.timescale(rows, ["s"]), series.packed_features(packed, ["s"])):
        assert {x["s"]: x["timescale"] for x in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("whole", [1, 8, 1 << 16])
def test_fourier_of_prime_and_composite_lengths(spark, whole):
    r = np.random.default_rng(2)
    data = {str(n): r.normal(size=n) for n in (1, 2, 3, 8, 12, 97, 211, 360, 1021, 1024)}
    got = series.fourier(table(spark, data), ["s"], whole=whole).toPandas()
    for k, x in data.items():
        mine = got[got.s == k].sort_values("k")
        assert mine.k.tolist() == list(range(len(x)))
        assert np.allclose(mine.re + 1j * mine.im, np.fft.fft(x), atol=1e-9 * len(x))


def test_amplitudes_of_long_and_short_series(spark):
    r = np.random.default_rng(3)
    data = {"a": r.normal(size=400), "b": r.normal(size=401), "c": r.normal(size=50), "zero": np.zeros(30), "one": np.array([4.0]), "long zero": np.zeros(300)}
    by = [{x["s"]: (x["alff"], x["falff"]) for x in series.alff(table(spark, data), ["s"], whole=w).collect()} for w in (100, 1 << 16)]
    for k, x in data.items():
        t = np.arange(len(x))
        a = np.abs(np.fft.rfft(x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x * 0))
        f = np.arange(len(a)) / (len(x) * series.TR)
        band = a[(f >= series.LOW) & (f <= series.HIGH)].sum()
        for got in by:
            assert math.isclose(got[k][0], band, abs_tol=1e-8)
            assert math.isnan(got[k][1]) if "zero" in k or k == "one" else math.isclose(got[k][1], band / a.sum(), abs_tol=1e-10)


def test_no_series(spark):
    none = spark.createDataFrame([], "s string, t long, value double")
    assert [f(none, ["s"]).count() for f in (series.acf, series.timescale, series.alff, series.fourier)] == [0, 0, 0, 0]
