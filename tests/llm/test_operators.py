"""The text operators against brute force, and their edge cases: nulls, empty and long texts, repeated rows, empty tables and
extra columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import bytesops, components, decontaminate, jaccard, katz, langid, licences, mixing, quality, suffix, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, h long, node long, key string, n int"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghiklmnoprstuéß") for _ in range(r.randint(2, 8))) for _ in range(n)]


def texts():
    r, words = random.Random(4), vocabulary(1)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, base = say(90), [say(n) for n in (3, 6, 12, 40, 120, 300, 900)]
    out = [None, "", " \t\n", "Ab", "12 34 !!", *base, *base]
    for b in base[2:]:
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        w[0] = w[-1] = "Other"
        out.append("  ".join(w).upper() if len(w) > 100 else "\n".join(w))
    out += [say(30) + " " + passage + " " + say(20) for _ in range(4)] + [passage + " " + passage]
    out += ["né " * 400, "né " * 300, say(4000), "x" * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], 0, 1.0, i, i, i, "k", 1) for i, t in enumerate(texts())]
    rows += [rows[7], rows[0], (None, "no id here", "en", "a", 0, 0.0, 0, 0, 0, "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    r = random.Random(0)
    chain, names = 2000, r.sample(range(1000, 9000), 2001)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(names[i], names[i + 1]) for i in range(chain)]
    pairs += [(20000, 20001 + i) for i in range(500)]  # a hub
    root, before = {x: x for p in pairs for x in p}, None
    while root != before:
        before = dict(root)
        for a, b in pairs + pairs[::-1]:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got.get(x, x) == y for x, y in root.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = bytesops.span_hash(bytesops.prefix_hash(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]


def test_jaccard_against_all_pairs(docs, nothing):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = [(i, shingles(t)) for i, t in rows_of(docs)]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                x, y = rows[a][1], rows[b][1]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for k, (i, s) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = Counter((i, len(s), least.get(label[k]) if s else i) for k, (i, s) in enumerate(rows))
    assert Counter(map(tuple, jaccard.similar(docs).select("doc_id", "n_shingles", "component_id").collect())) == want
    assert jaccard.similar(nothing).count() == 0


@pytest.mark.parametrize(("tile", "sample", "hot_rows"), [(512, 8, 1 << 22), (4, 1, 2)])
def test_jaccard_chains_and_tiles(spark, monkeypatch, tile, sample, hot_rows):
    """A chain of texts, each similar to the next only, is one component; small tiles and hot parts give the same."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 160])) for i in range(16)] + [(100 + i, " ".join(words[200:300] + [f"u{i}_{j}" for j in range(60)])) for i in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot_rows).collect()}
    assert {got[i] for i in range(16)} == {0} and all(got[100 + i] == 100 + i for i in range(12))


def test_parity_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (5, 70, 300, 2000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[n // 5 :], r.integers(0, 1 << 63, n // 7, dtype=np.uint64)]))
        apart = jaccard.distance(np.frombuffer(jaccard.dense_sketch(x), np.uint64), np.frombuffer(jaccard.dense_sketch(y), np.uint64))
        assert apart <= len(np.setxor1d(x, y))
        for keys, difference in jaccard.parts(x):
            assert len(np.unique(keys)) > difference or n < 8


def brute_repeats(rows):
    data, seen = [(t or "").encode() for _, t in rows], Counter()
    for b in data:
        seen.update(b[i : i + suffix.LENGTH] for i in range(len(b) - suffix.LENGTH + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - suffix.LENGTH + 1):
            if seen[b[s : s + suffix.LENGTH]] > 1:
                hit[s : s + suffix.LENGTH] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((i, len(b), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("spans", "piece"), [(1000, 1 << 20), (1, 1 << 20), (1000, 1500)])
def test_suffix_against_all_strings(docs, nothing, monkeypatch, spans, piece):
    """Also with cores that are all too large for one index, and with texts longer than a piece."""
    monkeypatch.setattr(suffix, "INDEX_SPANS", spans)
    monkeypatch.setattr(suffix, "PIECE", piece)
    got = suffix.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows_of(docs))
    if spans > 1:
        assert suffix.cut_repeats(nothing).count() == 0


def test_run_length_index_is_the_longest_match():
    r = random.Random(2)
    base = bytes(r.choice(b"ab") for _ in range(60))
    spans = [base + bytes([c]) + base[:30] for c in b"xyz"] + [base[20:] + base[:40]]
    text, n = [], 0
    for k, s in enumerate(spans):
        text += [*s, 256 + k]
    text = np.array(text)
    got = suffix.RunLengthIndex(text, 200).matching_statistics()
    for i in range(len(text)):
        best = 0
        for j in range(len(text)):
            n = 0
            while i != j and i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        assert got[i] == best


def brute_hits(rows, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = word(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if x := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    found |= x
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


def test_decontamination_against_all_windows(spark, docs, nothing):
    rows = rows_of(docs)
    long_ = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(0, None), (1, ""), (2, " ".join(long_[0].split()[3:20])), (3, long_[1].upper()), (4, "Ab"), (5, "12 34"), (6, "né né né"), (6, "nowhere to be found at all"), (None, " ".join(long_[2].split()[5:16])), (2, " ".join(long_[0].split()[3:20])), (11, "né " * 30)]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, w int, term string")
    got = decontaminate.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    assert Counter(map(tuple, got)) == brute_hits(rows, items)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    near = decontaminate.search(spark.createDataFrame([(1, "alpha one two beta three"), (2, "alpha " + "z " * 20 + "beta")], "doc_id long, text string"), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), slop=4)
    assert [tuple(r)[0] for r in near.collect()] == [1]


def test_decontamination_of_long_items_and_large_benchmarks(spark, monkeypatch):
    r = random.Random(7)
    words = [f"t{i}" for i in range(400)]
    long = [r.choice(words) for _ in range(1500)]
    bench = spark.createDataFrame([("long", " ".join(long)), ("long", " ".join(long[:700])), ("short", "t1 t2 t3"), ("one", "t9")], "item_id string, text string")
    texts = [long[40:49], long[40:50], ["x", *long[1480:], "y"], ["t1", "t2", "t3"], ["t1", "t2"], ["t9"], [*long[690:704]], long[:5] + ["x"] + long[6:12]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = decontaminate.items_of(bench, "item_id", "text")
    counts = items.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    windows = decontaminate.windows_of(items, counts, 10)
    arrays = [c for c, kind in windows.dtypes if kind.startswith("array")]
    assert windows.agg(F.max(F.greatest(*[F.size(c) for c in arrays], F.lit(0)))).first()[0] <= 19

    def spans(t, name, item):
        k = min(10, len(item))
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)}
        return {(name, j) for i in range(len(t) - k + 1) if tuple(t[i : i + k]) in grams for j in range(i, i + k)}

    want = []
    for i, t in enumerate(texts):
        hit = spans(t, "long", long) | spans(t, "short", ["t1", "t2", "t3"]) | spans(t, "one", ["t9"])
        want.append((i, len({j for _, j in hit}), ",".join(sorted({name for name, _ in hit}))))
    found = lambda: [tuple(x) for x in decontaminate.decontaminate(rows, bench).select("doc_id", "n_hit", F.array_join("items", ",")).orderBy("doc_id").collect()]
    assert found() == want and want[1][1] == 10
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found() == want
    assert decontaminate.partitions(0) == 4 and decontaminate.partitions(1 << 30) > 100


def test_katz_against_a_plain_model(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 3000)
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(marked).collect())
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)) + [None]) for i, t in rows_of(docs)]
    one, two = Counter(), Counter()
    for i, ts in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            for h, w in zip(["<s>", *ts], ts, strict=False):
                one[w] += 1
                two[h, w] += 1
    numbers = lambda c: katz.taken_from([Counter(c.values())[r] for r in range(1, 7)])
    d1, d2 = numbers(one), numbers(two)
    total, types = sum(one.values()), len(one)
    off = lambda d, c: d[min(c, 5)]
    unseen = sum(off(d1, c) for c in one.values()) / total
    p1 = lambda w: (one[w] - off(d1, one[w])) / total if one[w] else unseen
    contexts, given, taken = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        contexts[h] += c
        given[h] += p1(w)
        taken[h] += off(d2, c)
    alpha = {h: taken[h] / contexts[h] / (1 - given[h]) for h in contexts}
    for h in list(contexts)[:5]:  # every distribution sums to one
        seen = [w for g, w in two if g == h]
        assert math.isclose(sum((two[h, w] - off(d2, two[h, w])) / contexts[h] for w in seen) + alpha[h] * (sum(p1(w) for w in one if (h, w) not in two) + unseen), 1, rel_tol=1e-9)
    want = Counter()
    for i, ts in rows:
        s = sum(math.log10((c - off(d2, c)) / contexts[h]) if (c := two[h, w]) else math.log10(alpha.get(h, 1) * p1(w)) for h, w in zip(["<s>", *ts], ts, strict=False))
        b = sum(math.log10((one[w] + 1) / (total + types + 1)) for w in ts)
        want[i, len(ts), sum(one[w] > 0 for w in ts), total, round(b, 6), round(s, 6)] += 1
    assert got == want
    assert katz.score(nothing.withColumn("train", F.lit(True))).count() == 0
    assert {r["score"] for r in katz.score(docs.withColumn("train", F.lit(False))).collect()} == {0.0}


def test_katz_keeps_ids_with_texts_when_the_input_is_read_in_another_order(spark, tmp_path):
    reads, words = str(tmp_path), [f"w{i}" for i in range(6)]

    def turned(batches):
        """One task's rows, begun at another row in each read."""
        import os
        import tempfile

        rows = pa.Table.from_batches(list(batches))
        os.close(tempfile.mkstemp(dir=reads)[0])
        at = len(os.listdir(reads)) % rows.num_rows
        yield from pa.concat_tables([rows.slice(at), rows.slice(0, at)]).combine_chunks().to_batches()

    docs = spark.createDataFrame([(f"d{i}", " ".join(words[: 1 + i % 6] * (1 + i)), i % 3 > 0) for i in range(31)], "doc_id string, text string, train boolean").coalesce(1)
    seen = lambda frame: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.score(frame).collect())
    want = seen(docs)
    assert [(i, n) for i, n, *_ in want] == sorted((f"d{i}", (1 + i % 6) * (1 + i) + 1) for i in range(31))
    assert seen(docs.mapInArrow(turned, docs.schema)) == want
    assert len(list(tmp_path.iterdir())) > 2


def test_katz_notices_a_missing_block():
    texts = pa.table({"block": pa.array([], pa.int64()), "texts": pa.array([], pa.binary())})
    with pytest.raises(katz.ChangedBlocks):
        katz._score_block(katz.Model([0] * 8, [0] * 8, 0), 0)(texts, pa.table({"block": [5]}))


def test_katz_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (katz.unpack_counts(katz.pack_counts(counts), 6) == counts).all()


def test_mixing(docs, nothing, spark):
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows_of(docs))
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    total = sum(r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert math.isclose(sum(x[0]["target"] for x in by.values()), total, rel_tol=1e-9)
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)
    assert mixing.mix(nothing).count() == 0


def test_mixing_targets_stop_and_reshare(spark):
    rows = spark.createDataFrame([("a", 10, 1), ("b", 10, 1), ("c", 1000, 5), ("d", 100, 1), (None, 80, 1)], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    weight, size = dict(zip("abcd", (1, 2, 3, 1), strict=True)) | {None: 2}, {"a": 10, "b": 10, "c": 1000, "d": 100, None: 80}
    stopped = set()
    while True:
        rest, share = sum(size.values()) - sum(3 * size[s] for s in stopped), sum(w for s, w in weight.items() if s not in stopped)
        over = {s for s in size if s not in stopped and rest * weight[s] / share > 3 * size[s]}
        if not over:
            break
        stopped |= over
    assert all(math.isclose(got[s], 3 * size[s] if s in stopped else rest * weight[s] / share) for s in size)


def test_mixing_draws_are_unbiased(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    taken = defaultdict(list)
    for seed in range(4):
        for r in mixing.mix(docs, seed=seed).collect():
            taken[r["source"], r["size"]].append(r["copies"] - r["target"] / r["source_size"])
    assert all(abs(np.mean(x)) < 0.25 for x in taken.values())


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 8))
    vs = [*(b + r.normal(0, s, 8) for b in base for s in (0, 0.02, 0.05, 0.1, 0.3)), base[0], base[0], base[1] * 3]
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vs)]
    rows += [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [1.0, None], 0), (104, [float(x) for x in base[0]], None), (105, [], 1), (106, [float(x) for x in base[0][:4]], 0), (30, rows[30][1], 0)]
    got = Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    sound = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
    links = {(a, b) for a in sound for b in sound if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.98}
    label = [x[0] for x in rows]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = Counter((rows[k][0], sum(a == k for a, _ in links), label[k], label[k] == rows[k][0]) for k in range(len(rows)))
    assert got == want
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    monkeypatch.setattr(vectors, "CELL", 10)
    r = np.random.default_rng(5)
    base = r.normal(size=5)
    v = np.array([base + r.normal(0, 0.15, 5) for _ in range(60)])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & ~np.eye(60, dtype=bool)
    got = {x["vec_id"]: x["n_links"] for x in vectors.near_duplicates(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == dict(enumerate(near.sum(1)))


def test_licences(spark, docs, nothing):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0."), (2, "MIT License\n\nPermission is hereby granted. Released under the MIT License. All rights reserved!"), (3, None), (4, ""), (5, "GNU General Public License\nVersion 3, 29 June 2007"), (6, "Version 3, 29 June 2007\nGNU General Public License"), (5, "GNU General Public License\nVersion 3, 29 June 2007")]
    got = Counter(map(tuple, licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sentence_ids", "licences").collect()))
    assert got == Counter([(1, "apache-notice", "Apache-2.0"), (2, "mit-title,mit-notice,arr", "AllRightsReserved,MIT"), (3, "", ""), (4, "", ""), (5, "gpl3-title,gpl3-version", "GPL-3.0"), (6, "gpl3-version,gpl3-title", ""), (5, "gpl3-title,gpl3-version", "GPL-3.0")])
    assert licences.scan(docs).count() == docs.count() and licences.scan(nothing).count() == 0


def test_licences_in_wrapped_texts(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
    asf = """The ASF licenses this file to You under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance with
the License."""
    led = lambda leader, text: "\n".join(leader + line for line in text.split("\n"))
    cases = [
        ("MIT License\n\nCopyright (c) 2020 A. Body\n\n" + mit, "mit-title,mit-grant,mit-condition", "MIT"),
        ("Copyright 2020 Body\n" + mit.replace("\n", "\r\n"), "mit-grant,mit-condition", "MIT"),
        (led("# ", mit), "mit-grant,mit-condition", "MIT"),
        (led("dnl ", mit), "mit-grant,mit-condition", "MIT"),
        ("Copyright 2020 Body\nAll rights reserved.\n\n" + bsd, "arr,bsd-grant,bsd-source,bsd-binary", "AllRightsReserved,BSD-2-Clause"),
        ("/*\n" + led(" * ", bsd.replace("1.", "(1)").replace("2.", "b)")) + "\n */", "bsd-grant,bsd-source,bsd-binary", "BSD-2-Clause"),
        (led(";; ", apache), "apache-header,apache-file,apache-site", "Apache-2.0"),
        (apache.replace("Licensed", "Also licensed").replace("http:", "https:"), "apache-file,apache-site-tls", "Apache-2.0"),
        (led("// ", asf), "apache-asf,apache-file", "Apache-2.0"),
        ("                Apache License\n          Version 2.0, January 2004\n", "apache-title,apache-version", "Apache-2.0"),
        ("MIT License\nMIT License\nreleased under the\nMIT License", "mit-title,mit-title,mit-notice", "MIT"),
        ("Released under\n\nthe MIT License. You may not use this file except in compliance\nwith the License.", "apache-file", ""),
    ]
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["sentence_ids"], r["licences"]) for r in got] == [tuple(want) for _, *want in cases]


def test_licences_of_full_texts_and_gaps(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution.\n"
    advert = "\n3. All advertising materials mentioning features or use of this software must\ndisplay the following acknowledgement:\nThis product includes software of a body.\n"
    endorse = "\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from this\nsoftware without specific prior written permission.\n"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
    gpl = "This program is free software{0} you can redistribute it and/or modify\n it under the terms of the GNU {1}General Public License as published by\n the Free Software Foundation{2} either version {3} of the License, or\n (at your option) any later version."
    cases = [
        (bsd, "BSD-2-Clause"),
        (bsd + endorse, "BSD-3-Clause"),
        (bsd + advert + endorse, "BSD-4-Clause"),
        (bsd.replace("1. Redist", "All rights reserved.\n\n1. Redist"), "AllRightsReserved,BSD-2-Clause"),
        (endorse + bsd, "BSD-2-Clause"),
        (isc + ", provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        (isc + ".", "0BSD"),
        (gpl.format(";", "", ";", 2), "GPL-2.0-or-later"),
        (gpl.format(":", "", ",", 3), "GPL-3.0-or-later"),
        (gpl.format(";", "Lesser ", ";", 2.1), "LGPL-2.1-or-later"),
        (gpl.format(":", "Affero ", ",", 3), "AGPL-3.0-or-later"),
        ("GNU GENERAL PUBLIC LICENSE\n    Version 2, June 1991", "GPL-2.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007", "LGPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"),
        ("This software is provided 'as-is', without any express or implied\nwarranty. Nobody is liable. Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
        ("Creative Commons Attribution-ShareAlike 4.0 International Public License", "CC-BY-SA-4.0"),
        ("Version 2, June 1991", ""),
    ]
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licences"] for r in got] == [want for _, want in cases]
    assert len({name for name, _ in licences.ALL_RULES}) >= 40 and all(i == licences.GAP or i in licences.KNOWN for _, ids in licences.ALL_RULES for i in ids)
    words = [" ".join(re.findall("[a-z0-9]+", x)) == x for x in licences.KNOWN.values()]
    assert all(words) and len(set(licences.KNOWN.values())) == len(words)


def test_licences_by_notice_tag_and_organisation(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    endorse = "* Neither the name of {} nor the names of its contributors may be used to endorse or\npromote products derived from this software without specific prior written permission.\n"
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of {} as published by the Free Software Foundation."
    cases = [
        (bsd + endorse.format("Google Inc. nor"), "BSD-2-Clause"),
        (bsd + endorse.format("Google Inc"), "BSD-3-Clause"),
        (bsd + endorse.format("the\nUniversity of Somewhere"), "BSD-3-Clause"),
        (bsd + endorse.format("a " * 13), "BSD-2-Clause"),
        (gpl.format("the GNU General Public License version 2"), "GPL-2.0-only"),
        (gpl.format("version 3 of the GNU Affero General Public License"), "AGPL-3.0-only"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("SPDX-License-Identifier: Unknown-1.0", ""),
        ("mit\nisc", ""),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        ("Code is\ndistributed under the Apache License 2.0", "Apache-2.0"),
        ("Code is distributed under\nthe Apache License, 2.0", "Apache-2.0"),
        ("It is licensed under the GPLv3!", "GPL-3.0"),
        ("word " * 20 + "licensed under the MIT License", ""),
        ("x" * 300_000 + ". Licensed under the MIT License. " + "no words " * 40_000, "MIT"),
        ("Not licensed under the MITIGATED License", ""),
    ]
    cases[0] = (bsd + endorse.format("nor"), "BSD-3-Clause")  # a name is any words
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licences"] for r in got] == [want for _, want in cases]
    assert all(any(sign in s for sign in licences.SIGNS) for s in [*licences.KNOWN.values(), *licences.FREE.values()])


def labelled(spark, n=400):
    r, words = random.Random(8), vocabulary(2, 200)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(r.choice(words) for _ in range(60))
        rows.append((i, (text[:200] + " loweX" + r.choice(words) + " Scum " + text[200:]) if bad else text.upper().replace(" ", "!! ") if i % 3 == 1 else text))
    docs = spark.createDataFrame([*rows, (None, None), (n, None), (n + 1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(n)), (0, 1, 1), (2, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark, docs, nothing):
    train, labels = labelled(spark)
    model = toxicity.fit(train, labels.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(train, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(0, 400, 4)]) > 0.95
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(train, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_factorization_learns_a_pair():
    """Two terms that only together mean the label: beyond any sum of weights."""
    r, a, b = random.Random(1), 11, 22
    rows = [(int(x and y), np.unique(np.array([k for k, on in ((a, x), (b, y)) if on] + [r.randint(1000, 1030) for _ in range(5)], np.uint64)).tobytes()) for x, y in ((r.random() < 0.5, r.random() < 0.5) for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.binary())], ["y", "terms"])
    m = toxicity.unpack(bytes(next(toxicity._trainer(64, 4, 12, 0.0)(iter([batch]))).column("model")[0].as_py()))
    i, j = np.searchsorted(m["keys"], [a, b])
    assert m["v"][i] @ m["v"][j] > 0.5


def test_quality(spark, docs, nothing, monkeypatch):
    train, labels = labelled(spark)
    model = quality.fit(train, labels.where("doc_id % 4 <> 0"), epochs=6)
    got = {r["doc_id"]: r["score"] for r in quality.score(train, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 1) for i in range(0, 400, 4)]) > 0.95
    assert quality.score(docs, model).count() == docs.count() and quality.score(nothing, model).count() == 0
    m = quality.unpack(model)
    data = np.frombuffer(b"some LONG text " * 30000, np.uint8)
    codes, row = quality.layout(data, np.array([0, len(data)]))
    z = np.concatenate([quality.forward(codes[k : k + 100], row[k : k + 100], 1, m)["z"] for k in range(0, len(codes), 100)])
    whole = np.array([z.mean(), z.max(), z.min()]) @ m["mixture"] + m["bias"]
    assert math.isclose(quality._long(data, m), whole, rel_tol=1e-4)


def test_quality_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        codes, _ = quality.layout(np.arange(n).astype(np.uint8), np.array([0, n]))
        seen = set()
        for k, c in enumerate(codes):
            seen |= {k * quality.STRIDE + p for p in np.flatnonzero(c != quality.PAD)}
        assert seen == set(range(n))


def test_language(spark, docs, nothing):
    r = random.Random(3)
    kinds = {"en": ["the", "and", "with", "house", "water", "thing"], "de": ["der", "und", "nicht", "haus", "wasser", "schön"], "es": ["el", "con", "casa", "agua", "niño", "año"]}
    rows = [(i, " ".join(r.choice(kinds[k]) for _ in range(25)), k) for i, k in enumerate(list(kinds) * 40)]
    frame = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), (902, "12 + 34!", "de"), (903, "house WATER", None)], "doc_id long, text string, lang string")
    model = langid.fit(frame.where("doc_id % 5 <> 0"))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(frame, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i][0] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    kept = langid.keep_identified(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(rows) + 1
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(nothing, model).count() == 0
    assert langid.fit(frame.where("lang is null")) is None
