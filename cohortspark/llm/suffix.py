"""Suffix-array dedup: repeated passages by a run-length index.

Which strings of LENGTH bytes start at more than one place? A string's anchor is its least GRAM-byte hash, so
equal strings have equal anchors at equal offsets, and the corpus' suffixes can be dealt out by anchor.
An item is an anchor with the run of window starts that it serves; windows of an item share a
core of bytes, and only items that share a core with another item need a closer look. Items with equal
spans are settled by counting. The spans that are left are indexed in batches of cores: a suffix array gives
the Burrows-Wheeler transform, its runs are kept with samples at both ends (text position and
common prefix with the neighbour), and matching statistics stream over the text from sample to
sample, each position one less than the one before until the next sample. Positions that match LENGTH bytes or more
are marked. A core with more spans than fit one index is split by offset into narrower cores first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import bytesops as B
from .common import bound_resources, join_hot, key_filter, passes, saved

LENGTH, GRAM = 400, 64
REACH = LENGTH - GRAM + 1  # offsets of the anchor in a window
CELL = -(-REACH // 2)
PIECE = 1 << 18
PLACE_BITS = 20  # a piece has fewer than 2^PLACE_BITS places
INDEX_SPANS = 500  # spans of one core in one index
INDEX_BYTES = 1 << 18
STRETCH = 1 << 16  # cuts are merged by stretches of so many bytes
BUCKET_BYTES = 1 << 21
_U = np.uint64


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row, offset of the piece in its row); pieces of a long row overlap by LENGTH - 1 bytes."""
    for at, to, data, bounds in B.chunks(column, PIECE):
        if to == at + 1 and len(data) > 2 * PIECE:
            for base in range(0, len(data) - LENGTH + 1, PIECE):
                part = data[base : base + PIECE + LENGTH - 1]
                yield part, np.array([0, len(part)]), np.array([at]), np.array([base])
        else:
            yield data, bounds, np.arange(at, to), np.zeros(to - at, np.int64)


def items(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Items of a chunk: row, anchor p (in the chunk), offsets omin..omax of the windows served, core, span's sig, cell."""
    starts = np.maximum(0, np.diff(bounds) - LENGTH + 1)
    if not starts.sum():
        return {k: np.zeros(0, np.int64) for k in ("row", "p", "omin", "omax", "cell")} | {k: np.zeros(0, _U) for k in ("core", "sig")}
    prefix = B.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    bits, n = _U(PLACE_BITS), len(at)
    padded = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, _U)
    padded[:n] = (B.span_hash(prefix, at, at + GRAM) >> bits << bits) | at.astype(_U)
    blocks = padded.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    del padded, blocks, at
    first = np.repeat(bounds[:-1] - (np.cumsum(starts) - starts), starts)
    s = first + np.arange(starts.sum())
    row = np.repeat(np.arange(len(starts)), starts)
    anchor = (np.minimum(behind[s], ahead[s + REACH - 1]) & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
    del ahead, behind, first
    cell = (anchor - s) // CELL
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(s)) - 1
    p, cell, row = anchor[head], cell[head], row[head]
    omax, omin = p - s[head], p - s[tail]
    low, high = cell * CELL, np.minimum(cell * CELL + CELL, REACH) - 1
    core = B.mix(B.span_hash(prefix, p - low, p - high + LENGTH) + cell.astype(_U))
    sig = B.mix(B.span_hash(prefix, p - omax, p - omin + LENGTH) + core * _U(0x9E3779B97F4A7C15) + (omin * 4096 + omax).astype(_U))
    return {"row": row, "p": p, "omin": omin, "omax": omax, "cell": cell, "core": core, "sig": sig}


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, bounds, _row, _base in _pieces(batch.column("text")):
            core, count = np.unique(items(data, bounds)["core"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(count)], ["core", "n"])


def _items(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bounds, row, base in _pieces(batch.column("text")):
                x = items(data, bounds)
                keep = np.flatnonzero(passes(bits, x["core"]))
                own = x["row"][keep]
                pick = pa.array(row[own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pick), batch.column("h").take(pick), pa.array(x["p"][keep] - bounds[own] + base[own]), pa.array(x["omin"][keep].astype(np.int32)), pa.array(x["omax"][keep].astype(np.int32)), pa.array(x["cell"][keep].astype(np.int32)), pa.array(x["core"][keep].view(np.int64)), pa.array(x["sig"][keep].view(np.int64))],
                    ["id", "h", "p", "omin", "omax", "cell", "core", "sig"],
                )

    return run


def _spans(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = B.Recent()
        for batch in batches:
            for data, bounds, _row, _base in _pieces(batch.column("text")):
                x = items(data, bounds)
                sigs, first = np.unique(x["sig"].view(np.int64), return_index=True)
                wanted = passes(bits, sigs)
                first = first[wanted][recent.new(sigs[wanted])]
                got = [(s, data[p - high : p - low + LENGTH].tobytes()) for s, p, low, high in zip(x["sig"][first].view(np.int64).tolist(), x["p"][first].tolist(), x["omin"][first].tolist(), x["omax"][first].tolist(), strict=True)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([c for _, c in got], pa.binary())], ["sig", "span"])

    return run


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of a text with samples at both ends of each run.

    Symbols are integers; a symbol of its own ends each span, so no match crosses spans."""

    def __init__(self, text: np.ndarray, longest: int) -> None:
        n = len(text)
        wide = np.concatenate([text, np.zeros(2, np.int64)])
        base = int(wide.max()) + 2
        key = ((wide[:n] + 1) * base + wide[1 : n + 1] + 1) * base + wide[2 : n + 2] + 1
        self.text, self.levels, step = text, [], 3
        while True:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
            self.levels.append((step, rank.astype(np.int32)))
            if step > longest or rank[order[-1]] == n - 1:
                break
            behind = np.full(n, -1, np.int64)
            behind[: n - step] = rank[step:] if step < n else 0
            key = rank * (n + 1) + behind + 1
            step *= 2
        self.suffixes = order
        transform = text[order - 1]
        change = np.flatnonzero(transform[1:] != transform[:-1]) + 1
        self.run_starts = np.concatenate([[0], change])
        self.run_ends = np.concatenate([change, [n]]) - 1
        up, down = self.run_starts[1:], self.run_ends[:-1]
        self.samples_up = (order[up], self._common(order[up - 1], order[up]))
        self.samples_down = (order[down], self._common(order[down], order[down + 1]))
        self.edges = (order[0], order[-1])
        del self.levels

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, by ranks of ever shorter prefixes."""
        n, out = len(self.text), np.zeros(len(i), np.int64)
        for step, rank in reversed(self.levels):
            a, b = i + out, j + out
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]) & (np.maximum(a, b) + step <= n)
            out[same] += step
        for _ in range(2):
            a, b = i + out, j + out
            same = (a < n) & (b < n) & (self.text[np.minimum(a, n - 1)] == self.text[np.minimum(b, n - 1)])
            out[same] += 1
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with any other position."""
        n, best = len(self.text), np.zeros(len(self.text), np.int64)
        place = np.arange(n)
        for (at, length), edge in ((self.samples_up, self.edges[0]), (self.samples_down, self.edges[1])):
            known = np.full(n, -1, np.int64)
            known[at] = length
            known[edge] = 0
            last = np.maximum.accumulate(np.where(known >= 0, place, 0))
            np.maximum(best, np.maximum(0, np.maximum(known[last], 0) - (place - last)), out=best)
        return best


def repeated(spans: list[bytes]) -> list[np.ndarray]:
    """For each span a flag for each of its windows: does it also occur in another span? Spans differ."""
    sizes = np.array([len(s) for s in spans])
    data = np.frombuffer(b"".join(spans), np.uint8).astype(np.int64)
    begin = np.cumsum(sizes) - sizes + np.arange(len(sizes))
    text = np.empty(len(data) + len(sizes), np.int64)
    ends = begin + sizes
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = data
    text[ends] = 256 + np.arange(len(sizes))
    found = RunLengthIndex(text, int(sizes.max())).matching_statistics() >= LENGTH
    return [found[b : b + n - LENGTH + 1] for b, n in zip(begin, sizes, strict=True)]


def _index(group: pa.Table) -> pa.Table:
    """Index a bucket of cores, a few at a time; returns repeated offsets (parent, low, high)."""
    group = group.sort_by([("core", "ascending"), ("sub", "ascending")])
    core, parent, omax = (group.column(c).to_pylist() for c in ("core", "parent", "omax"))
    spans = [bytes(s) for s in group.column("span").to_pylist()]
    out: tuple[list, list, list] = ([], [], [])
    at = 0
    while at < len(spans):
        to, size = at, 0
        while to < len(spans) and (size < INDEX_BYTES or core[to] == core[to - 1]):
            size += len(spans[to])
            to += 1
        for i, flags in zip(range(at, to), repeated(spans[at:to]), strict=True):
            if parent[i] is None or not flags.any():
                continue
            edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            for low, high in zip(edge[::2], edge[1::2], strict=True):
                out[0].append(parent[i])
                out[1].append(omax[i] - (int(high) - 1))
                out[2].append(omax[i] - int(low))
        at = to
    return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["parent", "low", "high"])


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split an item's offsets at the middle of its cell; each half has a longer core."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            middle = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                omin, omax = max(lo, r["omin"]), min(hi, r["omax"])
                if omin > omax:
                    continue
                zero = r["omax"]  # the anchor's place in the span
                core = r["span"][zero - lo : zero - hi + LENGTH]
                span = r["span"][zero - omax : zero - omin + LENGTH]
                digest = lambda *x: int.from_bytes(hashlib.blake2b(repr(x[:-1]).encode() + x[-1], digest_size=8).digest(), "little", signed=True)
                rows.append((digest(lo, hi, core), digest(lo, hi, omin, omax, span), r["parent"], omin, omax, lo, hi, span))
        names = ["core", "sub", "parent", "omin", "omax", "lo", "hi", "span"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def repeated_offsets(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(sig, low, high): offsets of an item's windows that start elsewhere too."""
    sigs = saved(found.groupBy("core", "cell", "sig", "omin", "omax").agg(F.count("*").alias("n")))
    cores = sigs.groupBy("core").agg(F.count("*").alias("spans"), F.min("n").alias("least"))
    settled = [sigs.where("n > 1").select("sig", F.col("omin").alias("low"), F.col("omax").alias("high"))]
    mixed = saved(join_hot(sigs, cores.where("spans > 1 and least = 1").withColumn("rows", F.col("spans")), "core", "rows", sigs.count()))
    text_of = texts.mapInArrow(_spans(key_filter(mixed, "sig")), "sig long, span binary").groupBy("sig").agg(F.any_value("span").alias("span"))
    work = mixed.join(text_of, "sig").select("core", F.col("sig").alias("sub"), F.when(F.col("n") == 1, F.col("sig")).alias("parent"), "omin", "omax", (F.col("cell") * CELL).alias("lo"), (F.least(F.col("cell") * CELL + CELL, F.lit(REACH)) - 1).alias("hi"), "span", "spans")
    work = saved(work)
    while True:
        here = work.where(F.col("spans") <= INDEX_SPANS)
        size = here.agg(F.sum(F.octet_length("span"))).first()[0] or 0
        if size:
            bucket = F.pmod(F.xxhash64("core"), F.lit(max(1, size // BUCKET_BYTES)))
            settled.append(saved(here.withColumn("bucket", bucket).select("bucket", "core", "sub", "parent", "omax", "span").groupBy("bucket").applyInArrow(_index, "parent long, low int, high int")).withColumnRenamed("parent", "sig"))
        large = work.where(F.col("spans") > INDEX_SPANS)
        if large.isEmpty():
            break
        kind = "core long, sub long, parent long, omin int, omax int, lo int, hi int, span binary"
        halves = saved(large.drop("spans", "sub").mapInArrow(_halve, kind))
        counted = saved(halves.groupBy("core", "sub", "omin", "omax", "lo", "hi").agg(F.count("*").alias("n"), F.count("parent").alias("open"), F.min("parent").alias("parent"), F.any_value("span").alias("span")))
        settled.append(halves.where("parent is not null").join(counted.where("n > 1").select("sub"), "sub").select(F.col("parent").alias("sig"), F.col("omin").alias("low"), F.col("omax").alias("high")))
        per_core = counted.groupBy("core").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 and least = 1")
        work = saved(join_hot(counted, per_core.withColumn("rows", F.col("spans")), "core", "rows", counted.count()).select("core", "sub", F.when(F.col("n") == 1, F.col("parent")).alias("parent"), "omin", "omax", "lo", "hi", "span", "spans"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def merged_cuts(cuts: DataFrame) -> DataFrame:
    """(id, h, cuts) from (id, h, lo, hi): for each text its cuts, those that overlap within a stretch merged, so that a
    text of n bytes has at most n / LENGTH of them and one for each stretch, however many items it has."""
    by_text = W.partitionBy("id", "h", "stretch").orderBy("lo")
    apart = F.col("lo") > F.coalesce(F.max("hi").over(by_text.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    runs = cuts.withColumn("stretch", F.floor(F.col("lo") / STRETCH)).withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_text.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("id", "h", "stretch", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, digests, kept = [], [], [], []
        data, bounds = B.string_bytes(batch.column("text"))
        cuts = batch.column("cuts").to_pylist()
        for i in range(batch.num_rows):
            text = data[bounds[i] : bounds[i + 1]].tobytes()
            runs: list[list[int]] = []
            for c in sorted(cuts[i] or [], key=lambda c: (c["lo"], c["hi"])):
                if runs and c["lo"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], c["hi"])
                else:
                    runs.append([c["lo"], c["hi"]])
            rest, at = [], 0
            for lo, hi in runs:
                rest.append(text[at:lo])
                at = hi
            rest.append(text[at:])
            left = b"".join(rest)
            removed.append(len(text) - len(left))
            spans.append(len(runs))
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "ignore"))
        sizes = np.diff(bounds)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), batch.column("extra")], ["id", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "extra"])


def cut_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, _h, n_bytes, n_removed, n_spans, kept_sha256, kept, extra): one row for each row of docs.

    Every byte covered by a LENGTH-byte string that also starts anywhere else goes. kept_sha256 is over the bytes that
    stay; kept is their text, without characters that a cut left incomplete. extra is a struct of the columns to carry.
    Null texts count as empty; texts shorter than LENGTH lose nothing; a repeated row is a repeated
    document. _h is the hash of the text that, with the id, is a row's key."""
    bound_resources(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("extra"))
    shared = texts.mapInArrow(_cores, "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).where("n > 1")
    bits = key_filter(shared, "core")
    found = saved(texts.mapInArrow(_items(bits), f"id {kind}, h long, p long, omin int, omax int, cell int, core long, sig long"))
    offsets = repeated_offsets(found, texts)
    cuts = found.select("id", "h", "p", "sig").join(offsets, "sig").select("id", "h", (F.col("p") - F.col("high")).alias("lo"), (F.col("p") - F.col("low") + LENGTH).alias("hi"))
    per_doc = merged_cuts(cuts)
    joined = whole.join(per_doc.select(F.col("id").alias("c_id"), F.col("h").alias("c_h"), "cuts"), F.expr("id <=> c_id and h = c_h"), "left").select("id", "h", "text", "cuts", "extra")
    out = joined.mapInArrow(_cut, f"id {kind}, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, extra {joined.schema['extra'].dataType.simpleString()}")
    return out.withColumnsRenamed({"id": doc_id, "h": "_h"})


def op6_suffix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
