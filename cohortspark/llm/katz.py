"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

    p(w | h) = (c(h, w) - taken(c(h, w))) / c(h)   if the pair was seen in training
             = alpha(h) p(w)                       otherwise; p(w) backs off to one class for all unseen words

alpha(h) is the mass that discounting takes from h's pairs over the p-mass of words not seen after h, so that every
distribution sums to one. Counts live in tables partitioned by a hash of the n-gram. Texts are
handled in blocks of about BLOCK_BYTES: a block asks each partition once for each distinct n-gram it holds, with its
own training counts, so no n-gram, however common, brings a partition more than one entry for each block. A row of
these tables is one (partition, block) with its n-grams packed in arrays.

Four steps, all partitioned: (1) blocks send n-grams, partitions add up counts and answer; (2) blocks score what was
seen, and send what their first-seen pairs take from and give to alpha, and the contexts they must back off
from; (3) partitions compute alpha and answer; (4) blocks add it up to a score for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import fold, saved

BLOCK_BYTES = 1 << 23
PARTITION_BYTES = 1 << 24  # of text for each partition of the tables
TOP = 5  # counts above it are not discounted
START, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5E6546B64)
_U = np.uint64
_C1, _C2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
WORD, PAIR = 1, 2
_ASK = "kind int, part int, block long, n long, check long, keys binary, counts binary"
_ANSWER = "kind int, part int, block long, n long, check long, counts binary, owns binary, stats array<long>"
_SECOND = "kind int, part int, block long, keys binary, one binary, two binary, docs binary"


class ChangedBlocks(ValueError):
    """The input was cut into other blocks when it was read again."""


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of a task's rows of about BLOCK_BYTES of text, numbered by task and order."""
    from pyspark import TaskContext

    at, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        start = 0
        for i, n in enumerate(lengths):
            size += int(n) + 8
            if size >= BLOCK_BYTES:
                held.append(batch.slice(start, i + 1 - start))
                yield at + number, pa.Table.from_batches(held)
                held, size, start, number = [], 0, i + 1, number + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield at + number, pa.Table.from_batches(held)


class Block:
    """Distinct words and pairs of a block, and each token's place among them."""

    def __init__(self, text: pa.ChunkedArray) -> None:
        hashes, sizes = [], []
        for _at, _to, data, bounds in B.chunks(text):
            low = B.ascii_lower(data)
            start, end, row = B.words(low, bounds, B.NOT_SPACE)
            hashes.append(B.span_hash(B.prefix_hash(low), start, end))
            sizes.append(np.bincount(row, minlength=len(bounds) - 1))
        words, count = np.concatenate(hashes), np.concatenate(sizes) + 1
        last = np.cumsum(count) - 1
        tokens = np.empty(len(words) + len(count), _U)
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        tokens[inner], tokens[last] = words, END
        context = np.empty_like(tokens)
        context[1:] = tokens[:-1]
        context[last - count + 1] = START
        self.doc, self.count = np.repeat(np.arange(len(count)), count), count
        self.words, self.word = np.unique(tokens, return_inverse=True)
        pairs = B.mix(context * _C1 + tokens * _C2 + _U(1)) >> _U(8)
        self.pairs, first, self.pair = np.unique(pairs, return_index=True, return_inverse=True)
        self.pair_word, self.pair_context = self.word[first], context[first]

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = train[self.doc]
        return np.bincount(self.word[weight], minlength=len(self.words)), np.bincount(self.pair[weight], minlength=len(self.pairs))


def _cuts(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Where each table partition's keys begin: partitions are ranges of the keys' high bits."""
    if not bits:
        return np.array([0, len(keys)])
    return np.append(np.searchsorted(keys >> _U(width - bits), np.arange(1 << bits, dtype=_U)), len(keys))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps in as many bytes as the largest gap takes."""
    gaps = np.diff(keys, prepend=_U(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.reshape(-1).view("<u8"), dtype=_U)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count below 255; larger ones follow in eight bytes each."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def squeeze(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<f8").tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), "<f8")


def stream(table: pa.Table) -> bytes:
    """Rows as one compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unstream(blob: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(keys, initial=0).view(np.int64)) if len(keys) else 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _blocks(batches):
            block = Block(table.column("text"))
            train = table.column("train").to_numpy()
            rows = []
            for kind, keys, counts, width in zip((WORD, PAIR), (block.words, block.pairs), block.counts(train), (64, 56), strict=True):
                cut = _cuts(keys, bits, width)
                for part, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        rows.append((kind, part, number, b - a, _check(keys[a:b]), pack_keys(keys[a:b]), pack_counts(counts[a:b])))
            yield _batch(rows, _ASK)

    return run


def _add_up(group: pa.Table) -> pa.Table:
    """A table partition's counts over all blocks, answered to each block in its own order."""
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    block, n, check = (group.column(c).to_pylist() for c in ("block", "n", "check"))
    order = sorted(range(len(block)), key=block.__getitem__)
    keys = [unpack_keys(k) for k in group.column("keys").to_pylist()]
    own = [unpack_counts(c, m) for c, m in zip(group.column("counts").to_pylist(), n, strict=True)]
    every, inverse = np.unique(np.concatenate([keys[i] for i in order]), return_inverse=True)
    mine = np.concatenate([own[i] for i in order])
    total = np.zeros(len(every), np.int64)
    np.add.at(total, inverse, mine)
    place = np.flatnonzero(mine > 0)
    _, first = np.unique(inverse[place], return_index=True)
    owns = np.zeros(len(mine), np.uint8)  # the first block that saw it in training answers for an n-gram
    owns[place[first]] = 1
    answer, rows, at = total[inverse], [], 0
    for i in order:
        to = at + n[i]
        rows.append((kind, part, block[i], n[i], check[i], pack_counts(answer[at:to]), np.packbits(owns[at:to]).tobytes(), None))
        at = to
    some = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2]
    rows.append((kind, part, -1, 0, 0, None, None, [int(total.sum()), int((total > 0).sum()), *some.tolist()]))
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


def taken_from(of: list[int]) -> np.ndarray:
    """How much Good-Turing takes from counts 0..TOP, from the numbers of n-grams seen 1..TOP+1 times; larger counts
    lose as much as TOP does, so that every context keeps some mass to back off with.

    Where the numbers are too few for discount ratios in (0, 1), every count loses a constant n1 / (n1 + 2 n2), at
    least 0.1 and at most 0.9."""
    n = np.array([0, *of], float)
    r = np.arange(1, TOP + 1)
    share = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    if (n[1 : TOP + 1] > 0).all() and share < 1:
        ratio = ((r + 1) * n[2 : TOP + 2] / (r * n[1 : TOP + 1]) - share) / (1 - share)
        if ((ratio > 0) & (ratio < 1)).all():
            return np.concatenate([[0], r * (1 - ratio)])
    constant = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.1))
    return np.concatenate([[0], np.full(TOP, constant)])


class Model:
    """What every block must know: totals and what discounting takes."""

    def __init__(self, words: list[int], pairs: list[int], docs: int) -> None:
        self.tokens, self.types, self.docs = words[0], words[1], docs
        self.from_word, self.from_pair = taken_from(words[2:]), taken_from(pairs[2:])
        few = words[2 : 2 + TOP]
        mass = np.dot(few, self.from_word[1:]) + (self.types - sum(few)) * self.from_word[TOP]
        self.unseen = mass / self.tokens if self.tokens else 1.0

    def word(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, (counts - self.from_word[np.minimum(counts, TOP)]) / self.tokens, self.unseen)

    def taken(self, counts: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self.from_pair[np.minimum(counts, TOP)] / np.maximum(context, 1)

    def pair(self, counts: np.ndarray, context: np.ndarray) -> np.ndarray:
        return counts / np.maximum(context, 1) - self.taken(counts, context)


def _answers(rows: pa.Table, kind: int, keys: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.filter(pc.equal(rows.column("kind"), kind)).sort_by("part")
    counts, owns, cut = [], [], _cuts(keys, bits, width)
    filled = [p for p in range(len(cut) - 1) if cut[p + 1] > cut[p]]
    if rows.column("part").to_pylist() != filled:
        raise ChangedBlocks
    for p, n, check, c, o in zip(filled, *(rows.column(x).to_pylist() for x in ("n", "check", "counts", "owns")), strict=True):
        if n != cut[p + 1] - cut[p] or check != _check(keys[cut[p] : cut[p + 1]]):
            raise ChangedBlocks
        counts.append(unpack_counts(c, n))
        owns.append(np.unpackbits(np.frombuffer(o, np.uint8), count=n).astype(bool))
    return np.concatenate(counts), np.concatenate(owns)


def _score_block(model: Model, bits: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if texts.num_rows != 1:
            raise ChangedBlocks
        number = texts.column("block")[0].as_py()
        held = unstream(texts.column("texts")[0].as_buffer())
        block = Block(held.column("text"))
        docs = len(block.count)
        words, _ = _answers(answers, WORD, block.words, bits, 64)
        pairs, owns = _answers(answers, PAIR, block.pairs, bits, 56)
        at = np.searchsorted(block.words, block.pair_context)
        known = block.pair_context != START
        context = np.full(len(pairs), model.docs)
        context[known] = words[at[known]]
        p_word = model.word(words)
        seen = pairs > 0
        p = np.where(seen, model.pair(pairs, context), p_word[block.pair_word])
        log = np.log10(np.where(p > 0, p, 1.0))
        base = np.log10((words + 1) / (model.tokens + model.types + 1))
        add = lambda v: np.bincount(block.doc, weights=v, minlength=docs)
        # contributions of first-seen pairs to their context's backoff weight
        own = np.flatnonzero(owns)
        contexts, which = np.unique(block.pair_context[own], return_inverse=True)
        taken = np.bincount(which, weights=model.taken(pairs[own], context[own]), minlength=len(contexts))
        given = np.bincount(which, weights=p_word[block.pair_word[own]], minlength=len(contexts))
        # contexts to back off from, for each text
        back = np.flatnonzero(~seen[block.pair] & (context[block.pair] > 0))
        asked, place = np.unique(block.pair_context[block.pair[back]], return_inverse=True)
        pending, times = np.unique(block.doc[back] * max(1, len(asked)) + place, return_counts=True)
        rows = []
        for kind, keys, one, two in ((1, contexts, taken, given), (2, asked, None, None)):
            cut = _cuts(keys, bits, 64)
            for part, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    rows.append((kind, part, number, pack_keys(keys[a:b]), None if one is None else squeeze(one[a:b]), None if two is None else squeeze(two[a:b]), None))
        per_doc = np.stack([block.count, add(words[block.word] > 0), add(base[block.word]), add(log[block.pair])]).astype(np.float64)
        rows.append((3, -1, number, stream(held.select(["id", "train"])), pack_keys(pending.astype(_U)), pack_counts(times), per_doc.tobytes()))
        return pa.Table.from_batches([_batch(rows, _SECOND)])

    return run


def _alphas(group: pa.Table) -> pa.Table:
    """log10 alpha of a table partition's contexts, for those that blocks ask for."""
    kind = np.array(group.column("kind").to_pylist())
    columns = {c: group.column(c).to_pylist() for c in ("part", "block", "keys", "one", "two")}
    ask, give = np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)
    rows = []
    if len(ask):
        order = sorted(give, key=lambda i: columns["block"][i])
        empty = [np.zeros(0, _U)]
        given_keys = [unpack_keys(columns["keys"][i]) for i in order]
        keys, which = np.unique(np.concatenate(empty + given_keys), return_inverse=True)
        floats = lambda c: np.concatenate([np.zeros(0)] + [unsqueeze(columns[c][i], len(k)) for i, k in zip(order, given_keys, strict=True)])
        taken = np.bincount(which, weights=floats("one"), minlength=len(keys))
        given = np.bincount(which, weights=floats("two"), minlength=len(keys))
        for i in ask:
            wanted = unpack_keys(columns["keys"][i])
            at = np.searchsorted(keys, wanted)  # a context with a count has pairs, so it is there
            alpha = np.log10(np.maximum(taken[at], 1e-300) / np.maximum(1 - given[at], 1e-300))
            rows.append((4, columns["part"][i], columns["block"][i], None, alpha.tobytes(), None, None))
    return pa.Table.from_batches([_batch(rows, _SECOND)])


def _finish(group: pa.Table) -> pa.Table:
    rows = group.sort_by("part").to_pylist()
    number = rows[0]["block"]
    own = next(r for r in rows if r["kind"] == 3)
    alpha = np.concatenate([np.zeros(0)] + [np.frombuffer(r["one"]) for r in rows if r["kind"] == 4])
    per_doc = np.frombuffer(own["docs"]).reshape(4, -1)
    pending = unpack_keys(own["one"]).astype(np.int64)
    times = unpack_counts(own["two"], len(pending))
    score = per_doc[3] + np.bincount(pending // max(1, len(alpha)), weights=times * alpha[pending % max(1, len(alpha))] if len(alpha) else None, minlength=per_doc.shape[1])
    held = unstream(own["keys"])
    return pa.Table.from_arrays([held.column("id"), held.column("train"), pa.array(per_doc[0].astype(np.int64)), pa.array(per_doc[1].astype(np.int64)), pa.array(per_doc[2]), pa.array(score)], ["id", "train", "n_tokens", "n_known", "base_score", "score"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's rows as one compressed Arrow stream: less to shuffle than rows, and ids stay with their texts."""
    for number, table in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([stream(table.combine_chunks())], pa.binary())], ["block", "texts"])


def _run(rows: DataFrame, kind: str) -> DataFrame:
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("train").alias("docs")).first()
    bits = max(0, ((facts["bytes"] or 0) // PARTITION_BYTES).bit_length())
    asked = rows.select("train", "text").mapInArrow(_ask(bits), _ASK)
    answers = saved(asked.groupBy("kind", "part").applyInArrow(_add_up, _ANSWER))
    stats = {r["kind"]: r["s"] for r in answers.where("block = -1").groupBy("kind").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(TOP + 3)]).alias("s")).collect()}
    nothing = [0] * (TOP + 3)
    model = Model(stats.get(WORD, nothing), stats.get(PAIR, nothing), facts["docs"])
    texts = rows.select("id", "train", "text").mapInArrow(_packed, "block long, texts binary")
    second = saved(texts.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(_score_block(model, bits), _SECOND))
    alphas = second.where("kind in (1, 2)").groupBy("part").applyInArrow(_alphas, _SECOND)
    scores = second.where("kind = 3").unionByName(alphas).groupBy("block").applyInArrow(_finish, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select("id", "train", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, train: str = "train", *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs; `train` is a boolean
    column that marks the rows to learn from (null: no).

    Null texts count as empty: one end token. Without training rows every word is in the class of unseen words and every
    score is 0. Blocks follow the input's partitions and are read twice, the second time with their ids; if the input comes back in other partitions
    (a cluster that lost executors may plan a scan differently), the run starts again on a written copy."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(train), F.lit(False)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    try:
        out = saved(_run(rows, kind))
    except Exception as problem:
        if "ChangedBlocks" not in str(problem):
            raise
        out = saved(_run(saved(rows), kind))
    return out.withColumnRenamed("id", doc_id)


def op3_katz(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) != 2).alias("train"))
    out = score(docs)
    return out.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
