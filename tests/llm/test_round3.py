"""Periodic runs, risk-controlled rules and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import bytesops, periodic, rules, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, repeats=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if repeats and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    four = [best[0], best[1], best[2], 1000 * best[1] // best[2]] if best else [None] * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return [len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))]


def periodic_texts(seed, count):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        words = ["".join(r.choice("abé") for _ in range(r.randint(1, 3))) for _ in range(r.choice([1, 2, 4, 30]))]
        t = [r.choice(words) for _ in range(r.choice([0, 1, 11, 12, 13, 40, 90, 250]))]
        if t and r.random() < 0.5:
            t += t[-r.randint(1, len(t)) :] * r.randint(1, 4)
        out.append(r.choice([" ", "\n", " \t"]).join(t))
    return out


def test_extensions_against_loops():
    r = random.Random(3)
    for k in (1, 2, 30):
        w = np.array([-1, *[r.randrange(k) for _ in range(400)], -2, *[r.randrange(k) for _ in range(300)], -3], np.int32)
        e = periodic.Extensions(w)
        pairs = np.array([p for p in np.random.default_rng(k).integers(0, len(w), (3000, 2)) if p[0] != p[1]])
        want = []
        for i, j in pairs:
            m = 0
            while max(i, j) + m < len(w) and w[i + m] == w[j + m]:
                m += 1
            want.append(m)
        assert e(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_cover_has_every_difference():
    assert {(a - b) % periodic.PERIOD for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.PERIOD))


@pytest.mark.parametrize("grid", [1, periodic.GRID])
def test_runs_against_plain_scan(monkeypatch, grid):
    monkeypatch.setattr(periodic, "GRID", grid)
    for seed in range(12):
        texts = periodic_texts(seed, 9)
        ids = [random.Random(seed).randint(0, 500) + k for k in range(len(texts))]
        data, bounds = bytesops.string_bytes(pa.array(texts))
        got = periodic._described(data, bounds, np.array([zlib.crc32(str(i).encode()) for i in ids]))
        assert [list(x) for x in zip(*got, strict=True)] == [plain_row(i, t) for i, t in zip(ids, texts, strict=True)]


def test_periodic_rows(spark):
    r = random.Random(9)
    texts = [None, "", " \t\n", "one", "a b " * 2000, "x" * 3000, " ".join(str(r.random()) for _ in range(3000)), *periodic_texts(5, 40)]
    rows = [(k if k % 9 else None, t, "clash", 1) for k, t in enumerate(texts)] + [(4, texts[4], "again", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, h int").repartition(3)
    key = lambda row: (row[0] is not None, row[0] or 0, row[-1], row[-2])
    for repeats in (True, False):
        got = sorted((list(x) for x in periodic.detect(docs, repeats=repeats).collect()), key=key)
        assert got == sorted(([i, *plain_row(i, t, repeats)] for i, t, *_ in rows), key=key)
    assert periodic.detect(docs.where("false")).collect() == []


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    r = random.Random(2)
    base = [None, "", " \n\t\x0b\x0c\r ", "\x85   é", "#*$ %&|<>#", "a b c d e f g h", "A a\nA a\n\nA a \n A a", "w " * 500, "x" * 5000, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1"]
    for _ in range(60):
        words = [r.choice(["aé", "B", "c#", "dd|"]) for _ in range(r.randint(1, 6))]
        t = [r.choice(words) for _ in range(r.randint(1, 90))]
        base.append("".join(x + r.choice([" ", "  ", "\n", "\r\n", "\t"]) for x in t))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(base)], "k int, text string")
    got = {x[0]: tuple(x)[1:] for x in rules.statistics(docs, "k").select("k", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {k: plain_statistics(t) for k, t in enumerate(base)}


def exact_tail(k, n, p):
    q = Fraction(p)
    return float(sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))


def test_binomial_tail(spark):
    cases = [(k, n, p) for p in (0.01, 0.002) for n in (1, 7, 500, 2000) for k in range(min(n, 25)) if k < n * p]
    for p in (0.01, 0.002):
        mine = [(k, n) for k, n, q in cases if q == p]
        frame = spark.createDataFrame(mine, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t"))
        for k, n, t in frame.collect():
            assert t == pytest.approx(exact_tail(k, n, p), rel=1e-9)
    large = spark.sql("select 9500L k, 1000000L n union all select 10000L, 1000000L union all select 0L, 1000000000L").select("k", rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t"))
    values = {r["k"]: r["t"] for r in large.collect()}
    assert 2e-7 < values[9500] < 3e-7 and values[10000] == 1.0 and values[0] == 0.0  # about -5.02 standard deviations


def judged_rows():
    r = random.Random(6)
    out, labels = [], []
    plain = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(40))
    for k in range(1600):
        lang = ["en", "de", None, "xx"][0 if k < 900 else 1 if k < 1500 else 2 if k < 1590 else 3]
        good = k % 4 > 0
        text = plain() if good else " ".join(x + "$%" * r.randint(0, 2) for x in plain().split())
        if good and k % 200 == 1:
            text += " ###" * 30
        out.append((k, text, lang))
        labels.append((k, int(good)))
    out += [(5000, None, "en"), (5001, "", None), (5002, "z " * 50, "de"), (3, out[3][1], "en"), (None, plain(), "en"), (5003, "$$$ " + plain(), "zz"), (5004, plain() + " $" * 200, "en")]
    labels += [(3, 1), (None, 0), (7, None), (11, 5), (5003, 0), (13, 0), (4, 1), (9000, 1)]  # 13 and 4 are now labelled both ways
    return out, labels


def test_verdicts_against_plain_calibration(spark):
    out, labels = judged_rows()
    docs = spark.createDataFrame([(*x, "clash", 1) for x in out], "doc_id long, text string, lang string, stratum string, n_words int").repartition(4)
    marks = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, base_failed int")
    limit, level = 0.1, 0.05
    got = rules.judge(docs, marks, limit=limit, level=level).select("doc_id", "base_failed", "kept", "rejected_by").collect()
    ys = {}
    for i, y in labels:
        if i is not None and y in (0, 1):
            ys.setdefault(i, set()).add(y)
    stats = [(i, lang, plain_statistics(t)) for i, t, lang in out]
    failed = lambda s: s[0] < 20 or 100 * s[6] > 30 * s[0]
    div = lambda a, b: a / b if b else None
    values = lambda s: (div(s[2], s[0]), div(s[1], s[0]), div(s[5], s[4]), div(s[6], s[0]), div(s[3], s[1]))
    good = {}
    for i, lang, s in stats:
        if ys.get(i) == {1} and not failed(s):
            good.setdefault(lang, []).append(values(s))
    cuts = {}
    for lang, rows in good.items():
        for r, rule in enumerate(rules.RULES):
            for c in rule.cutoffs:
                k = sum(v[r] is not None and v[r] > c for v in rows)
                p = limit / len(rules.RULES)
                if k >= len(rows) * p or exact_tail(k, len(rows), p) > level / (len(good) * len(rules.RULES)):
                    break
                cuts[lang, r] = c
    want = []
    for i, lang, s in stats:
        by = [rule.name for r, rule in enumerate(rules.RULES) if (lang, r) in cuts and (v := values(s)[r]) is not None and v > cuts[lang, r]]
        by = "" if failed(s) else ",".join(by)
        want.append((i, failed(s), not failed(s) and not by, by))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert cuts and not any(lang in ("xx", None) for lang, _ in cuts)
    assert sum("symbols_per_word" in x[3] for x in want) > 200
    # nothing is rejected without labels, and empty tables give none
    assert all(x["kept"] != x["base_failed"] for x in rules.judge(docs, marks.where("false"), limit=limit).collect())
    assert rules.judge(docs.where("false"), marks).collect() == []


def whitened(frame, **options):
    model = whitening.fit(frame, **options)
    return model, whitening.whiten(frame, model).toPandas()


def plain_spectrum(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    c = x - x.mean(0)
    values, q = np.linalg.eigh(c.T @ c / len(c))
    return x.astype(np.int64), c, values[::-1], q[:, ::-1]


@pytest.mark.parametrize("dims, guard", [(40, 8), (40, 24), (5, 24)])
def test_whitening_against_eigh(spark, dims, guard):
    rng = np.random.default_rng(dims + guard)
    vectors = (rng.standard_normal((700, dims)) * np.geomspace(5, 0.05, dims) + rng.standard_normal(dims)).astype(np.float32)
    odd = [(None, [1.0] * dims), (1000, None), (1001, [math.nan] * dims), (1002, [math.inf] + [0.0] * (dims - 1)), (1003, [1.0] * (dims + 1)), (1004, []), (1005, [None] * dims)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(7, vectors[7].tolist())] + odd
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, n string").repartition(3)
    kept = [r for r in rows if r[1] and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]
    x, c, values, q = plain_spectrum([r[1] for r in kept])
    model, out = whitened(frame, guard=guard)
    k = min(8, dims)
    assert len(out) == k * len(kept) and model.residual < 1e-12
    assert np.allclose(model.values, values[:k], rtol=1e-11)
    assert np.abs(np.abs((model.vectors * q[:, :k]).sum(0)) - 1).max() < 1e-12
    assert 0 <= model.identity_error < 1e-10 and np.allclose(model.values / model.trace, values[:k] / values.sum(), rtol=1e-11)
    deviation = sorted(((len(x) * x - x.sum(0)) ** 2).sum(1).tolist())
    for j in range(k):
        mine = out[out.component == j + 1]
        assert sorted(mine.deviation) == deviation
        want = c @ q[:, j] / np.sqrt(values[j])
        here = mine[mine.vec_id.notna()].sort_values("vec_id").whitened.to_numpy()
        order = sorted((r[0], w) for r, w in zip(kept, want, strict=True) if r[0] is not None)
        sign = np.sign(here[np.abs(here).argmax()] * order[int(np.abs(here).argmax())][1])
        assert np.allclose(here, sign * np.array([w for _, w in order]), atol=1e-8)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        _, out = whitened(make(rows))
        assert len(out) == 0 and list(out.columns)[:3] == ["vec_id", "component", "n"]
    model, out = whitened(make([(i, [float(i), 2.0 * i, 1e300]) for i in range(10)]))  # rank one, and an entry beyond what is held
    assert len(model.values) == 1 and len(out) == 10 and np.allclose(np.sort(out.whitened.abs()), np.sort(np.abs(np.arange(10) - 4.5) / np.sqrt(8.25)))
    model, out = whitened(make([(i, [1e3 * (i == k) for k in range(3)]) for i in range(3)] * 40))  # two equal eigenvalues
    assert len(model.values) == 2 and model.identity_error < 1e-9 and out.deviation.notna().all()
    _, out = whitened(make([(i, [1e9 * i]) for i in range(40)]))  # too large for a long
    assert out.deviation.isna().any() and out.whitened.notna().all()
