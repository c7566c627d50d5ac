"""Toxicity: a second-order factorization machine over hashed terms.

Terms are whole words and word beginnings of three to six bytes, hashed to 64 bits. The terms with
the strongest association in the labelled sample get a weight and a factor vector; a text's
score is sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the terms that occur in it, so that
two terms together can weigh more, or less, than each alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import fold, labelled_sample, pack, train_in_one_task, unpack

PREFIXES = (3, 4, 5, 6)


def terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term occurrence of a chunk."""
    low = B.latin_lower(data)
    start, end, row = B.words(low, bounds, B.WORD)
    prefix = B.prefix_hash(low)
    hashes, rows = [B.span_hash(prefix, start, end)], [row]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        hashes.append(B.mix(B.span_hash(prefix, start[long], start[long] + n) + np.uint64(n)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("_y").to_numpy(zero_copy_only=False)
        for at, to, data, bounds in B.chunks(batch.column("text")):
            hashes, rows = terms(data, bounds)
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            keep = np.ones(len(rows), bool)
            keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            hashes, rows = hashes[keep], rows[keep]
            cut = np.searchsorted(rows, np.arange(to - at + 1))
            blobs = [hashes[cut[i] : cut[i + 1]].tobytes() for i in range(to - at)]
            yield pa.RecordBatch.from_arrays([pa.array(labels[at:to], pa.int32()), pa.array(blobs, pa.binary())], ["y", "terms"])


def _trainer(max_terms: int, factors: int, epochs: int, log_odds: float, seed: int = 7):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, docs = [], []
        for batch in batches:
            ys += batch.column("y").to_pylist()
            docs += [np.frombuffer(x, np.uint64) for x in batch.column("terms").to_pylist()]
        if not docs or len(set(ys)) < 2:
            return
        order = sorted(range(len(docs)), key=lambda i: (ys[i], len(docs[i]), docs[i][:1].tobytes()))
        y, docs = np.array(ys, np.float64)[order], [docs[i] for i in order]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        keys, inverse = np.unique(np.concatenate(docs), return_inverse=True)
        hit = np.bincount(inverse, minlength=len(keys))
        positive = np.bincount(inverse, weights=y[owner], minlength=len(keys))
        n, n1 = len(y), y.sum()
        expected = hit * n1 / n
        chi2 = (positive - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * (1 - hit / n), 1e-9)
        chi2[hit < max(3, 0.003 * n)] = 0
        chosen = np.sort(np.argsort(-chi2, kind="stable")[: min(max_terms, int((chi2 > 6.6).sum()))])
        place = np.full(len(keys), -1)
        place[chosen] = np.arange(len(chosen))
        used = place[inverse]
        owner, used = owner[used >= 0], used[used >= 0]
        cut = np.searchsorted(owner, np.arange(n + 1))
        rng = np.random.default_rng(seed)
        w, v, b = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors)), 0.0
        gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
        for epoch in range(epochs):
            shuffled = rng.permutation(n)
            for at in range(0, n, 64):
                docs_ = shuffled[at : at + 64]
                x = np.zeros((len(docs_), len(w)))
                for i, d in enumerate(docs_):
                    x[i, used[cut[d] : cut[d + 1]]] = 1
                xv = x @ v
                z = b + x @ w + 0.5 * (xv**2 - x @ v**2).sum(1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs_]) / len(docs_)
                dw = x.T @ error + 2e-4 * w
                dv = x.T @ (error[:, None] * xv) - v * (x.T @ error)[:, None] + 2e-3 * v
                db = error.sum()
                gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
                w, v, b = w - 0.1 * dw / np.sqrt(gw), v - 0.02 * dv / np.sqrt(gv), b - 0.1 * db / np.sqrt(gb)
        b += log_odds - np.log(n1 / (n - n1))  # from the sample's share of the label to the share among all labels
        yield pa.RecordBatch.from_arrays([pa.array([pack(keys=keys[chosen], w=w, v=v, b=np.array(b))], pa.binary())], ["model"])

    return fit


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: int = 3000, max_terms: int = 4096, factors: int = 4, epochs: int = 8) -> bytes | None:
    """Train on at most about 2 x rows_per_class labelled rows; None if either class is missing."""
    share = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share = min(max(share or 0.5, 1e-3), 1 - 1e-3)
    sample = labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("_label")), "doc_id", "_label", rows_per_class)
    rows = sample.select("_y", "text").mapInArrow(_term_rows, "y int, terms binary")
    return train_in_one_task(rows, _trainer(max_terms, factors, epochs, float(np.log(share / (1 - share)))))


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(model)
        index, w, v, b = B.Keys(m["keys"]), m["w"], m["v"], float(m["b"])
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for at, to, data, bounds in B.chunks(batch.column("text")):
                hashes, rows = terms(data, bounds)
                which, term = index.find(hashes)
                pair = np.unique(rows[which] * max(1, len(w)) + term)
                row, term = pair // max(1, len(w)), pair % max(1, len(w))
                z = b + np.bincount(row, weights=w[term], minlength=to - at)
                for f in range(v.shape[1]):
                    x = v[term, f]
                    z += 0.5 * (np.bincount(row, weights=x, minlength=to - at) ** 2 - np.bincount(row, weights=x**2, minlength=to - at))
                scores[at:to] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    return run


def score(docs: DataFrame, model: bytes | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs. Null texts count as empty ones; empty texts get the
    intercept's score. Without a model (no labels of one class) every score is 0."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(doc_id), F.lit(0.0).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"id {kind}, score double").withColumnRenamed("id", doc_id)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
