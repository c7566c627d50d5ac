"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in overlapping chunks that together cover all of it. Learned
filters of WIDTH bytes slide over each chunk (a filter is a table of byte weights for each offset),
their responses are max-pooled over the chunk, a small dense layer gives the chunk's logit, and the
mean, largest and smallest logit of the chunks combine into the document's probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import fold, labelled_sample, pack, train_in_one_task, unpack

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 256, 192, 5, 12, 16
PAD = 256  # the table row for places after a text's end
_AT_ONCE = 1 << 16


def layout(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks as rows of byte codes, and the text of each; an empty text is one chunk of padding."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-(size - CHUNK) // STRIDE) + 1)
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[row][:, None] + nth[:, None] * STRIDE + np.arange(CHUNK)
    inside = at < bounds[row + 1][:, None]
    codes = np.full(at.shape, PAD, np.int64)
    codes[inside] = data[at[inside]]
    return codes, row


def convolve(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    places = CHUNK - WIDTH + 1
    out = tables[0].take(codes[:, :places], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(codes[:, j : places + j], axis=0)
    return out


def forward(codes: np.ndarray, row: np.ndarray, rows: int, m: dict) -> dict:
    response = convolve(codes, m["tables"])
    pooled = response.max(1)
    hidden = np.maximum(0, pooled @ m["w1"] + m["b1"])
    z = hidden @ m["w2"] + m["b2"]
    first = np.searchsorted(row, np.arange(rows))
    count = np.bincount(row, minlength=rows)
    stats = np.stack([np.add.reduceat(z, first) / count, np.maximum.reduceat(z, first), np.minimum.reduceat(z, first)], 1)
    return {"response": response, "pooled": pooled, "hidden": hidden, "z": z, "count": count, "stats": stats, "logit": stats @ m["mixture"] + m["bias"]}


def _backward(codes: np.ndarray, row: np.ndarray, f: dict, error: np.ndarray, m: dict) -> dict:
    by_doc = error[:, None] * m["mixture"][None]
    dz = (by_doc[:, 0] / f["count"])[row]
    dz += np.where(f["z"] == f["stats"][row, 1], by_doc[row, 1], 0) + np.where(f["z"] == f["stats"][row, 2], by_doc[row, 2], 0)
    dh = dz[:, None] * m["w2"][None] * (f["hidden"] > 0)
    dp = dh @ m["w1"].T
    place = f["response"].argmax(1)
    n = np.arange(len(codes))[:, None]
    tables = np.empty_like(m["tables"])
    for j in range(WIDTH):
        flat = codes[n, place + j] * FILTERS + np.arange(FILTERS)
        tables[j] = np.bincount(flat.ravel(), weights=dp.ravel(), minlength=(PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
    return {"tables": tables, "w1": f["pooled"].T @ dh, "b1": dh.sum(0), "w2": f["hidden"].T @ dz, "b2": dz.sum(), "mixture": f["stats"].T @ error, "bias": error.sum()}


def _trainer(epochs: int, log_odds: float, seed: int = 11):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, texts = [], []
        for batch in batches:
            ys += batch.column("_y").to_pylist()
            data, bounds = B.string_bytes(batch.column("text"))
            texts += [data[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        if not texts or len(set(ys)) < 2:
            return
        order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i].tobytes()))
        y, texts = np.array(ys, np.float64)[order], [texts[i] for i in order]
        rng = np.random.default_rng(seed)
        m = {"tables": rng.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)), "w1": rng.normal(0, 0.4, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.array(0.0), "mixture": np.array([0.6, 0.2, 0.6]), "bias": np.array(0.0)}
        one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
        for epoch in range(epochs):
            shuffled, at = rng.permutation(len(y)), 0
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            while at < len(y):
                to, total = at, 0
                while to < len(y) and to - at < 32 and (to == at or total + len(texts[shuffled[to]]) < 2 * _AT_ONCE):
                    total += len(texts[shuffled[to]])
                    to += 1
                some, at = shuffled[at:to], to
                bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
                codes, row = layout(np.concatenate([texts[i] for i in some]), bounds)
                f = forward(codes, row, len(some), m)
                error = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y[some]) / len(some)
                step += 1
                for k, g in _backward(codes, row, f, error, m).items():
                    g = g + 1e-4 * m[k]
                    one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.999 * two[k] + 0.001 * g**2
                    m[k] = m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        m["bias"] = m["bias"] + log_odds
        yield pa.RecordBatch.from_arrays([pa.array([pack(**{k: np.asarray(v, np.float32) for k, v in m.items()})], pa.binary())], ["model"])

    return fit


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = 1500, max_bytes: int = 1 << 20, epochs: int = 8) -> bytes | None:
    """Train on about 2 x rows_per_class labelled rows; None if either class is missing.

    A training row longer than max_bytes (a parameter that bounds the trainer's memory) is left out of the
    sample; scoring reads every text whole."""
    sample = labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length(text) <= max_bytes), labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("_label")), "doc_id", "_label", rows_per_class)
    return train_in_one_task(sample.select("_y", "text"), _trainer(epochs, 0.0))


def _logits(data: np.ndarray, bounds: np.ndarray, m: dict) -> np.ndarray:
    out = np.empty(len(bounds) - 1)
    at = 0
    while at < len(out):
        to = max(at + 1, min(len(out), int(np.searchsorted(bounds, bounds[at] + _AT_ONCE, side="right")) - 1))
        size = bounds[to] - bounds[at]
        if to == at + 1 and size > 4 * _AT_ONCE:
            out[at] = _long(data[bounds[at] : bounds[to]], m)
        else:
            codes, row = layout(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            out[at:to] = forward(codes, row, to - at, m)["logit"]
        at = to
    return out


def _long(data: np.ndarray, m: dict) -> float:
    """A long text in pieces of many chunks each; pieces begin where a chunk begins, so no chunk is lost."""
    z, step = [], STRIDE * 256
    for at in range(0, max(1, len(data) - CHUNK + STRIDE), step):
        piece = data[at : at + step - STRIDE + CHUNK]
        codes, row = layout(piece, np.array([0, len(piece)]))
        z.append(forward(codes, row, 1, m)["z"])
    z = np.concatenate(z)
    return float(np.array([z.mean(), z.max(), z.min()]) @ m["mixture"] + m["bias"])


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(model)
        for batch in batches:
            logit = np.empty(batch.num_rows)
            for at, to, data, bounds in B.chunks(batch.column("text")):
                logit[at:to] = _logits(data, bounds, m)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -700, 700))))], ["id", "score"])

    return run


def score(docs: DataFrame, model: bytes | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row for each row of docs, over the whole text. Null texts count as empty ones,
    which are one chunk of padding. Without a model every score is 0.5."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(doc_id), F.lit(0.5).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"id {kind}, score double").withColumnRenamed("id", doc_id)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
