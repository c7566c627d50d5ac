"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability
in a language is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities, which a forward recursion over its bytes computes; a text's is the product
over its words. Piece probabilities are learned by expectation-maximisation over the same sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import bound_resources, fold, pack, unit, unpack

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SHORT = 32  # words of up to so many bytes are handled together, longer ones each by itself
CHUNK_BYTES = 1 << 20
PER_BYTE = 1e5  # every probability is scaled by this for each byte it covers, which keeps sums of SHORT bytes well inside doubles
FAR = 1e100  # the sums of a longer word are brought back towards 1 when they leave 1 / FAR to FAR
_LETTER = re.compile(r"[^\W\d_]")
_WORD_BYTES = B.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_START = np.uint64(0x5851F42D4C957F2D)


def vocabulary(path: str = VOCABULARY) -> tuple[np.ndarray, int]:
    """Sorted 64-bit keys of the vocabulary's pieces in lower case, and of every single byte; and the longest piece's bytes.

    A piece with a word mark only matches at a word's start, so it has a key of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    inner, opening = {bytes([b]) for b in range(256)}, set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lower()
        body = piece.lstrip("▁").encode()
        if body:
            (opening if piece[0] == "▁" else inner).add(body)
    keys = [_keys(sorted(inner)), _keys(sorted(opening)) ^ _START]
    return np.unique(np.concatenate(keys)), max(map(len, inner | opening))


def _keys(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return B.span_hash(B.prefix_hash(data), bounds[:-1], bounds[1:])


class Words:
    """Distinct words of a chunk: those of up to SHORT bytes as tables of pieces by end and length, the others one by one."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, index: B.Keys, longest: int) -> None:
        prefix = B.prefix_hash(data)
        self.long = np.flatnonzero(end - start > SHORT)
        self.long_words = [LongWord(prefix, a, b, index, longest) for a, b in zip(start[self.long].tolist(), end[self.long].tolist(), strict=True)]
        short = np.flatnonzero(end - start <= SHORT)
        self.order = short[np.argsort((start - end)[short], kind="stable")]
        start, self.length, self.n = start[self.order], (end - start)[self.order], len(end)
        self.width = int(self.length.max(initial=0))
        self.cells: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # piece's end, its length, words, pieces
        for to in range(1, self.width + 1):
            alive = int(np.searchsorted(-self.length, -to, side="right"))
            for n in range(1, min(longest, to) + 1):
                hashes = B.span_hash(prefix, start[:alive] + to - n, start[:alive] + to)
                if to == n:
                    word, piece = index.find(hashes ^ _START)
                    if len(word):
                        self.cells.append((to, n, word, piece))
                word, piece = index.find(hashes)
                if len(word):
                    self.cells.append((to, n, word, piece))

    def _forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[end, word]: probability of a short word's first `end` bytes over all segmentations, PER_BYTE for each byte."""
        alpha = np.zeros((self.width + 1, len(self.length)))
        alpha[0] = 1
        for to, n, word, piece in self.cells:
            alpha[to, word] += alpha[to - n, word] * p[piece] * PER_BYTE**n
        return alpha

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        """log of each word's probability over all segmentations."""
        out = np.empty(self.n)
        whole = self._forward(p)[self.length, np.arange(len(self.length))]
        with np.errstate(divide="ignore"):
            out[self.order] = np.log(whole) - self.length * np.log(PER_BYTE)
        out[self.long] = [w.forward(p)[-1] for w in self.long_words]
        return out

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of words that occur `count` times."""
        alpha, place = self._forward(p), np.arange(len(self.length))
        beta = np.zeros_like(alpha)
        beta[self.length, place] = 1
        weight = count[self.order] / alpha[self.length, place]
        uses = np.zeros(len(p))
        for to, n, word, piece in reversed(self.cells):
            flow = beta[to, word] * p[piece] * PER_BYTE**n
            uses += np.bincount(piece, weights=alpha[to - n, word] * flow * weight[word], minlength=len(p))
            beta[to - n, word] += flow
        for w, c in zip(self.long_words, count[self.long], strict=True):
            uses += c * w.expected(p)
        return uses


class LongWord:
    """A word of any length: its pieces by end, summed byte by byte on scaled sums."""

    def __init__(self, prefix: np.ndarray, start: int, end: int, index: B.Keys, longest: int) -> None:
        found = []
        for n in range(1, min(longest, end - start) + 1):
            hashes = B.span_hash(prefix, np.arange(start, end - n + 1), np.arange(start + n, end + 1))
            for h in (hashes, hashes[:1] ^ _START):
                at, piece = index.find(h)
                found.append(np.stack([at + n, np.full(len(at), n), piece]))
        ends = np.concatenate(found, 1)
        self.size, (self.end, self.n, self.piece) = end - start, ends[:, np.argsort(ends[0], kind="stable")]

    @staticmethod
    def _sum(size: int, end: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """log of the summed weights of all ways to each end, for pieces sorted by end."""
        cut, near, log, out = np.searchsorted(end, np.arange(size + 2)).tolist(), np.zeros(size + 1), 0.0, np.zeros(size + 1)
        near[0], begin = 1.0, end - n
        widest = int(n.max())
        for to in range(1, size + 1):
            a, b = cut[to], cut[to + 1]
            now = near[begin[a:b]] @ weight[a:b]
            if not 1 / FAR < now < FAR and now > 0:
                near[max(0, to - widest) : to] /= now
                log += np.log(now)
                now = 1.0
            near[to] = now
            out[to] = np.log(now) + log if now > 0 else -np.inf
        return out

    def forward(self, p: np.ndarray) -> np.ndarray:
        """log probability of the first 0, 1, ... bytes over all segmentations."""
        scaled = self._sum(self.size, self.end, self.n, p[self.piece] * PER_BYTE ** self.n.astype(float))
        return scaled - np.log(PER_BYTE) * np.arange(self.size + 1)

    def expected(self, p: np.ndarray) -> np.ndarray:
        begin = self.end - self.n
        order = np.argsort(self.size - begin, kind="stable")
        ahead = self.forward(p)
        behind = self._sum(self.size, (self.size - begin)[order], self.n[order], (p[self.piece] * PER_BYTE ** self.n.astype(float))[order]) - np.log(PER_BYTE) * np.arange(self.size + 1)
        share = np.exp(ahead[begin] + np.log(p[self.piece]) + behind[self.size - self.end] - ahead[-1])
        return np.bincount(self.piece, weights=share, minlength=len(p))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (and of any bytes beyond ASCII)."""
    return B.words(data, bounds, _WORD_BYTES)


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each distinct word, and each occurrence's index among them."""
    _, first, inverse = np.unique(B.span_hash(B.prefix_hash(data), start, end), return_index=True, return_inverse=True)
    return first, inverse


def _trainer(keys: np.ndarray, longest: int, rounds: int):
    def fit(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, lang = B.Keys(keys), [], None
        for batch in batches:
            lang = batch.column("lang")[0].as_py() if lang is None else lang
            for _at, _to, data, bounds in B.chunks(batch.column("text"), CHUNK_BYTES):
                low = B.latin_lower(data)
                start, end, _row = word_spans(low, bounds)
                if len(start):
                    first, inverse = distinct_words(low, start, end)
                    held.append((Words(low, start[first], end[first], index, longest), np.bincount(inverse).astype(float), inverse, _row, end - start))
        p = np.full(len(keys), 1 / len(keys))
        for _ in range(rounds):
            uses = sum((w.expected(p, c) for w, c, *_ in held), np.zeros(len(keys)))
            p = (uses + 0.01) / (uses.sum() + 0.01 * len(keys))
        p = p.astype(np.float32)
        usual = _usual([(w.log_probability(p.astype(float))[inverse], row, size) for w, _, inverse, row, size in held])
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([p.tobytes()], pa.binary()), pa.array([usual], pa.list_(pa.float64()))], ["lang", "p", "usual"])

    return fit


#: Texts of one language differ by at least this share of the mean, even if those learned from don't.
LEAST_SPREAD = 0.1


def _usual(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """What is usual in a language's own texts, from its words' log probabilities, texts and sizes: the mean log probability
    of a byte, its variance from text to text, and the variance that a single word brings in."""
    if not parts:
        return np.array([0.0, 0.0, np.inf])
    log, size = np.concatenate([x for x, _, _ in parts]), np.concatenate([n for _, _, n in parts])
    mean = log.sum() / size.sum()
    word = ((log - mean * size) ** 2).mean() / size.mean() ** 2
    texts = np.concatenate([np.stack([np.bincount(row, x), np.bincount(row, n), np.bincount(row)]) for x, row, n in parts], 1)
    texts = texts[:, texts[2] > 0]
    between = ((texts[0] / texts[1] - mean) ** 2 - word / texts[2]).mean()
    return np.array([mean, max((LEAST_SPREAD * mean) ** 2, between), word])


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_language: int = 800, max_bytes: int = 1 << 18, rounds: int = 3, path: str = VOCABULARY) -> bytes | None:
    """Piece probabilities of every language named in `lang`, from about docs_per_language documents of each
    (texts of up to max_bytes), chosen by a hash of the id. Languages are learned independently, one task each. None if no row has a language."""
    bound_resources(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    small = rows.where(F.octet_length("text") <= max_bytes)
    sample = small.join(F.broadcast(counts), "lang").where(unit(F.col("id").cast("string")) * F.col("n") < docs_per_language).select("lang", "text")
    keys, longest = vocabulary(path)
    found = sample.groupBy("lang").applyInArrow(_trainer(keys, longest, rounds), "lang string, p binary, usual array<double>").collect()
    if not found:
        return None
    found.sort(key=lambda r: r["lang"])
    return pack(keys=keys, longest=np.array(longest), p=np.stack([np.frombuffer(r["p"], np.float32) for r in found]), langs=np.array([r["lang"] for r in found]), usual=np.array([r["usual"] for r in found]))


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ascii_letter = B.byte_class((0x41, 0x5A), (0x61, 0x7A))
    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    out = seen[bounds[1:]] > seen[bounds[:-1]]
    for i in np.flatnonzero(~out):
        if bounds[i + 1] > bounds[i]:
            out[i] = _LETTER.search(data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")) is not None
    return out


def _labeller(model: bytes):
    """A function from a text column to its languages, their scores, and how far each text lies from what is usual in its
    language: mean log probability of a byte, in standard deviations of a text with as many words."""
    m = unpack(model)
    index, p, langs = B.Keys(m["keys"]), m["p"].astype(float), [str(x) for x in m["langs"]]
    usual = m.get("usual", np.tile([0.0, 0.0, np.inf], (len(langs), 1)))  # a model that doesn't say what is usual finds nothing unusual

    def label(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        preds, scores, apart = [], [], []
        for at, to, data, bounds in B.chunks(column, CHUNK_BYTES):
            low = B.latin_lower(data)
            total = np.zeros((len(langs), to - at))
            start, end, row = word_spans(low, bounds)
            if len(start):
                first, inverse = distinct_words(low, start, end)
                words = Words(low, start[first], end[first], index, int(m["longest"]))
                for k in range(len(langs)):
                    total[k] = np.bincount(row, weights=words.log_probability(p[k])[inverse], minlength=to - at)
            best = total.argmax(0)
            score = 1 / np.exp(np.maximum(total - total.max(0), -700)).sum(0)
            letters = _has_letter(data, bounds)
            preds += [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            scores.append(np.where(letters, score, 0.0))
            mean, between, word = usual[best].T
            words_of, bytes_of = np.maximum(1, np.bincount(row, minlength=to - at)), np.maximum(1, np.bincount(row, weights=end - start, minlength=to - at))
            apart.append((total.max(0) / bytes_of - mean) / np.sqrt(between + word / words_of + 1e-12))
        joined = lambda x: np.concatenate(x) if x else np.zeros(0)
        return preds, joined(scores), joined(apart)

    return label


def _scorer(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labeller(model)
        for batch in batches:
            preds, scores, _ = label(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(preds, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return run


def keep_identified(docs: DataFrame, model: bytes | None, *, text: str = "text", least: float = 0.5, unusual: float = 10.0) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language: with a score of at least `least`, and not less
    usual for a text of that language, of as many words, than `unusual` standard deviations.

    So gibberish and languages that were not learned go; short texts may lie further off than long ones. Texts of
    any length are judged as wholes; repeated rows stay or go together; null texts and texts without a letter go. Without a model
    nothing is rejected."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labeller(model)
        for batch in batches:
            preds, scores, apart = label(batch.column(text))
            yield batch.filter(pa.array([p != "und" and x >= least and a >= -unusual for p, x, a in zip(preds, scores, apart, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: bytes | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row for each row of docs, over the whole text; score is the language's
    share of the summed probabilities. Null texts, texts without a letter, and all texts if there
    is no model, are `und` with score 0. Equal probabilities go to the first language by code point."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(doc_id), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def op4_language(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
