"""The corpus pipeline: stage by stage against the operators' brute-force rules, on a small table."""

import os
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    words = ["the", "and", "with", "house", "water", "thing", "stone", "river", "over", "under", "green", "light"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))
    item, passage = say(30), say(100)
    rows = [(i, say(80), "en", "ab"[i % 2]) for i in range(30)]
    rows += [(40, rows[3][1], "en", "a"), (41, "12 34", "en", "a"), (42, None, "en", "a"), (43, say(40) + " " + item + " " + say(40), "en", "b"), (44, say(30) + " " + passage, "en", "b"), (45, passage + " " + say(35), "en", None)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        now = {r["doc_id"] for r in docs.collect()}
        gone = {"language_id": {41, 42}, "jaccard_join": {40}, "decontamination": {43}}.get(name, set())
        assert now == ids - gone, name
        if name != "mixing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "suffix_dedup":
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(passage) > 400 and all(passage[20:-20] not in text[i] for i in (44, 45))
        ids = now
    assert {r["doc_id"]: (r["size"], r["text"]) for r in docs.collect()} == {i: (len(re.findall(r"\S+", text[i])), text[i]) for i in ids}


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["the", "stone", "river", "under", "green"]) + str(r.randint(0, 500)) for _ in range(n))
    rows = [(i, say(60), "en", "ab"[i % 2], 1) for i in range(20)]
    rows += [(20, None, "en", "a", None), (21, "", None, None, 0), (22, " \t\n", "en", "b", 2), (None, say(50), None, None, None), (None, None, None, None, None), (23, say(60000), "en", "a", 1)]
    rows += [rows[2], rows[2], (3, say(40), "en", "b", 1)]
    names = ["id", "h", "node", "key", "n", "size", "nth", "rank", "score", "words", "comp", "extra"]
    return spark.createDataFrame([(*x, *[7] * len(names)) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)), len(rows)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_and_empty_tables(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs, n = awkward(spark)
    out = stage(spark, docs, folder[0])
    got = out.collect()
    if name != "mixing":
        assert out.columns == corpus_pipeline.COLUMNS
    lost = {"language_id": 4, "jaccard_join": 0}.get(name, 0)
    assert len(got) == n - lost, name
    empty = stage(spark, docs.where("doc_id < 0"), folder[0])
    assert empty.count() == 0 and empty.columns == out.columns


def test_run(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() == 32 and out.where("taken > 3 * size").count() == 0
    stages = {os.path.basename(os.path.dirname(f)) for f in out.inputFiles()}
    parent = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file://")))
    assert stages == {"4-mixing"} and os.listdir(parent) == ["4-mixing"]
