"""Vectorised helpers over Arrow string columns: bytes, words, hashes.

All of them work on a few hundred kilobytes of text at a time, so a task's memory does not
depend on the number of rows in a batch. A text longer than a chunk is a chunk of its own:
texts are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3  # of mallopt(3)


def _return_memory() -> None:
    """Let the C library give large arrays back to the system when they are freed: Python workers are reused from task to
    task, and would keep what the largest chunk took."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    mallopt(_M_MMAP_THRESHOLD, 1 << 22)
    mallopt(_M_TRIM_THRESHOLD, 1 << 24)


_return_memory()

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(_P))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; tables for a very long text go when an ordinary chunk comes."""
    kept = (1 << 20) + 1024
    have = len(_powers.get("p", ()))
    if have < n or have > kept >= n:
        _powers.clear()
        _powers.update({name: _power_table(max(n, kept), base) for name, base in (("p", _P), ("i", _P_INV))})
    return _powers["p"], _powers["i"]


def _power_table(n: int, base: int) -> np.ndarray:
    table = np.full(n, base, _U)
    table[0] = 1
    return np.multiply.accumulate(table, out=table)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; span_hash() reads any span's hash off them."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODES[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def ascii_lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def latin_lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0 to U+00DE, whose second byte shifts by 32."""
    out = ascii_lower(data)
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if values is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) for runs of rows of about `limit` bytes."""
    data, bounds = string_bytes(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes of a class; runs end with their row.

    Also usable as counts: np.bincount(row, minlength=rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    here = inside[data]
    before = np.empty_like(here)
    before[0], before[1:] = False, here[:-1]
    first = bounds[:-1]
    before[first[first < len(data)]] = False
    after = np.empty_like(here)
    after[-1], after[:-1] = False, here[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(here & ~before)
    end = np.flatnonzero(here & ~after) + 1
    per_row = np.diff(np.searchsorted(start, bounds))
    return start, end, np.repeat(np.arange(len(bounds) - 1), per_row)


class Recent:
    """Which keys are new: a direct-mapped memory of fixed size. It forgets, so a key may count as new again."""

    def __init__(self, bits: int = 18) -> None:
        self.held, self.mask = np.zeros(1 << bits, np.int64), np.int64((1 << bits) - 1)

    def new(self, keys: np.ndarray) -> np.ndarray:
        """Places of distinct keys (not 0) that are not held; they are held from now on."""
        slot = keys & self.mask
        fresh = np.flatnonzero(self.held[slot] != keys)
        self.held[slot[fresh]] = keys[fresh]
        return fresh


class Keys:
    """Membership and index of 64-bit keys in a fixed sorted set, with a bitmap before the search."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys, self.shift = keys, _U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are keys, and their index among the keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]
