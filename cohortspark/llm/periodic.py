"""Periodic runs of words, by longest common extensions over a difference cover.

Of a text's suffixes only those at places of a difference cover modulo PERIOD are sorted. Any two places reach, the same
few words further on, two places of the cover; so the longest common extension of two suffixes is a short word-by-word
comparison and one minimum over the sorted suffixes' common prefixes, read off a sparse table. Reversed texts give extensions
to the left. A run of period p and at least 2p words holds two neighbouring places of the grid 0, p, 2p, ... one
period apart, whose extensions to both sides are the run: all grids together have about n ln n places. Texts are short
beside a chunk of several, so a chunk's texts are one sequence with a mark of its own between every two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import bound_resources, table

#: Every difference modulo 31 is one of two members of the cover.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
LEAST, CHUNK, GRID = 12, 1 << 20, 1 << 19
_CLASS = np.full(PERIOD, -1)
_CLASS[list(COVER)] = np.arange(len(COVER))
#: How many words further on two places, given modulo PERIOD, are both in the cover.
_AHEAD = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


class Extensions:
    """Longest common extensions to the right in a sequence of integers that ends with a value found nowhere else."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.words = np.concatenate([words, -(2**30) - np.arange(2 * PERIOD, dtype=words.dtype)])  # no end is reached
        chains = [np.arange(c, n, PERIOD) for c in COVER]
        sizes = np.array([len(c) for c in chains])
        self.base = np.cumsum(sizes) - sizes
        places = np.concatenate(chains)
        after = np.arange(1, len(places) + 1)
        after[np.cumsum(sizes)[sizes > 0] - 1] = len(places)
        levels = self._levels(places, after)
        rank = levels[-1][0]
        order = np.argsort(rank)
        self.rank = rank
        common = np.zeros(max(1, len(places) - 1), np.int32)
        a, b = order[:-1].copy(), order[1:].copy()
        for step, (ranks, jump) in reversed(list(enumerate(levels))):
            ends = np.append(ranks, -1)
            same = np.flatnonzero((ends[a] == ends[b]) & (a < len(places)) & (b < len(places)))
            common[same] += 1 << step
            a[same], b[same] = jump[a[same]], jump[b[same]]
        self.least = [common]
        while (1 << len(self.least)) < len(places):
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            if len(last) <= half:
                break
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _levels(self, places: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ranks of the cover's suffixes by their first 1, 2, 4, ... blocks of PERIOD words, and the place that many blocks
        on. Blocks are compared by their 64-bit hashes: any order of blocks sorts suffixes with common beginnings together."""
        codes = B.mix(self.words.astype(np.int64).view(np.uint64) + np.uint64(B._P))
        block = np.zeros(len(places), np.uint64)
        for d in range(PERIOD):
            block = block * np.uint64(B._P) + codes[places + d]
        found, ranks = np.unique(block, return_inverse=True)
        levels, count, jump = [(ranks.astype(np.int64), after)], len(found), after
        while count < len(places):
            ranks, jump = levels[-1]
            behind = np.append(ranks, -1)[jump]
            found, wider = np.unique(ranks * (len(places) + 1) + behind + 1, return_inverse=True)
            beyond = np.append(jump, len(places))[jump]
            levels.append((wider.astype(np.int64), beyond))
            count = len(found)
        return levels

    def _step(self, i: np.ndarray, j: np.ndarray, out: np.ndarray, among: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Compare word by word from out[k] on, at most `most` words; gives those of `among` without a difference."""
        begin, t, level = out[among].copy(), 0, []
        most = np.broadcast_to(most, among.shape)
        while len(among):
            done = most <= t
            level.append(among[done])
            among, begin, most = among[~done], begin[~done], most[~done]
            same = self.words[i[among] + begin + t] == self.words[j[among] + begin + t]
            among, begin, most = among[same], begin[same], most[same]
            out[among] += 1
            t += 1
        return np.concatenate(level) if level else among

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i and j differ."""
        out = np.zeros(len(i), np.int64)
        among = self._step(i, j, out, np.arange(len(i)), _AHEAD[i % PERIOD, j % PERIOD])
        if not len(among):
            return out
        slot = lambda at: self.rank[self.base[_CLASS[at % PERIOD]] + at // PERIOD]
        a, b = slot(i[among] + out[among]), slot(j[among] + out[among])
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        blocks = np.empty(len(among), np.int64)
        for level in np.unique(k):
            here = np.flatnonzero(k == level)
            least = self.least[level]
            blocks[here] = np.minimum(least[low[here]], least[high[here] - (1 << level)])
        out[among] += blocks * PERIOD
        self._step(i, j, out, among, PERIOD)
        return out


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """All runs (start, end, period) of at least max(LEAST, 2 * period) words in a sequence that begins and ends with
    values found nowhere else, where no run is longer than `longest`; by start, then period, each with its smallest period."""
    n = len(words)
    right, left = Extensions(words), Extensions(words[::-1].copy())
    found = [np.zeros((0, 3), np.int64)]
    period, last = 1, longest // 2
    while period <= last:
        upto = period
        total = 0
        while upto <= last and total + (n - 1) // upto <= max(GRID, n):
            total += (n - 1) // upto
            upto += 1
        p = np.arange(period, upto)
        per = (n - 1) // p
        each = np.repeat(p, per)
        i = (np.arange(total) - np.repeat(np.cumsum(per) - per, per)) * each
        at = np.flatnonzero(words[i] == words[i + each])
        i, each = i[at], each[at]
        ahead = right(i, i + each)
        behind = left(n - i, n - i - each)
        enough = (ahead + behind >= each) & (ahead + behind + each >= LEAST)
        i, each, ahead, behind = i[enough], each[enough], ahead[enough], behind[enough]
        found.append(np.unique(np.stack([i - behind, i + each + ahead, each], 1), axis=0))
        period = upto
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    if len(every):  # a multiple of a run's period gives the same stretch
        first = np.append(True, (every[1:, :2] != every[:-1, :2]).any(1))
        every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def planted(n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each word of texts of n words the number of the word that stands there: where h % 10 is 0, a text's end repeats
    a stretch of it. h is the unsigned crc32 of the id, negative for none."""
    row = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    g, some = h // 10, np.maximum(n, 1)
    a = g % some
    p = 1 + (n - a) // (3 + g % 8)
    repeats = ((h >= 0) & (h % 10 == 0))[row] & (i >= a[row])
    return np.where(repeats, a[row] + (i - a[row]) % p[row], i)


def _described(data: np.ndarray, bounds: np.ndarray, h: np.ndarray | None) -> list[list]:
    """Columns n_runs ... collapsed_sha256 for a chunk of texts."""
    docs = len(bounds) - 1
    start, end, row = B.words(data, bounds, B.NOT_SPACE)
    n = np.bincount(row, minlength=docs)
    offset = np.cumsum(n) - n
    if h is not None:
        source = offset[row] + planted(n, h)
        start, end = start[source], end[source]
    codes = B.span_hash(B.prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
    place = np.arange(len(row)) + row + 1
    marks = offset + np.arange(docs)
    sequence = np.empty(len(row) + docs + 1, np.int32)
    sequence[place] = np.unique(codes, return_inverse=True)[1]
    sequence[np.append(marks, len(sequence) - 1)] = -1 - np.arange(docs + 1)
    found = runs(sequence, int(n.max(initial=0)))
    of = np.searchsorted(marks, found[:, 0], side="right") - 1
    begin, length, period = found[:, 0] - marks[of] - 1, found[:, 1] - found[:, 0], found[:, 2]
    edge = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(edge, found[:, 0] + period, 1)
    np.add.at(edge, found[:, 1], -1)
    kept = np.cumsum(edge)[place] == 0
    per_doc = np.bincount(of, minlength=docs)
    out: list[list] = [per_doc.tolist(), [], [], [], [], [], _collapsed(data, start[kept], end[kept], np.bincount(row[kept], minlength=docs))]
    at = 0
    for count in per_doc:
        mine = slice(at, at + count)
        at += count
        if count:
            k = at - count + int(np.lexsort((period[mine], begin[mine], -length[mine]))[0])
            values = [int(begin[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k])]
        else:
            values = [None] * 4
        text = "".join(f"{s},{m},{q}\n" for s, m, q in zip(begin[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
        for column, value in zip(out[1:6], [*values, hashlib.sha256(text.encode()).hexdigest()], strict=True):
            column.append(value)
    return out


def _collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> list[str]:
    """Digest of each text's kept words with a blank between every two."""
    size = end - start + 1
    to = np.cumsum(size)
    joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    inside = np.arange(len(joined)) - np.repeat(to - size, size)
    word = inside < np.repeat(size - 1, size)
    joined[word] = data[(np.repeat(start, size) + inside)[word]]
    ends = np.append(0, to)[np.cumsum(n)]
    begins = np.append(0, to)[np.cumsum(n) - n]
    return [hashlib.sha256(joined[a : max(a, b - 1)]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repeats: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): one row for each row of docs.

    Words are what blanks leave, compared by 64-bit hashes. A run holds at least LEAST words and two periods; the longest
    one is given (ties: smallest start, then period), and digests of all runs and of the text without the words that repeat a
    run's first period. With `repeats`, the ends of the texts that `planted` chooses are repeated first. Null, empty and
    blank texts have no words and no run; repeated rows are each their own; a null id is a text like others, never
    planted. Texts of any length are whole; a text longer than a chunk is one."""
    bound_resources(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), (F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(-1)) if repeats else F.lit(-1)).cast("long").alias("h"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *[c.split()[0] for c in COLUMNS.split(", ")]]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            for at, to, data, bounds in B.chunks(batch.column("text"), CHUNK):
                columns = _described(data, bounds, h[at:to] if repeats else None)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return rows.mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", doc_id)


def op11_periodic(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"), repeats=True)
