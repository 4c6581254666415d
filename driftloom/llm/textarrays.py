"""Arrow string columns as NumPy bytes, and the words in them, without a Python object per word."""

from __future__ import annotations

import ctypes
import inspect
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: the characters x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SPACES = bytes(np.flatnonzero(SPACE).astype(np.uint8))
#: Bytes of text that are worked on at once; longer texts come alone.
CHUNK = 1 << 21

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


_given_back = [0.0]


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for the next stage and count against the executor meanwhile."""
    if time.monotonic() - _given_back[0] < 0.2:
        return
    pa.default_memory_pool().release_unused()
    _given_back[0] = time.monotonic()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def tidy(task: Callable) -> Callable:
    """``task``, a function of Arrow batches or tables, which gives freed memory back when it ends."""
    if inspect.isgeneratorfunction(task):

        def stream(batches):
            yield from task(batches)
            give_back()

        return stream

    def one(table):
        out = task(table)
        give_back()
        return out

    def two(left, right):
        out = task(left, right)
        give_back()
        return out

    return two if len(inspect.signature(task).parameters) == 2 else one  # Spark counts the parameters


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def byte_table(lower: bool = True, seed: int = 20240229) -> np.ndarray:
    """A random 64-bit code for each byte; A-Z share those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


LOWER = byte_table()


def spans_of(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes that don't cross the row starts ``at``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at[(at >= 0) & (at <= n)]] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | edge[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    return starts, ends


def hash_sums(data: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Prefix sums from which ``run_hashes`` takes the hash of any run."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(len(data))[0][: len(data)], out=sums[1:])
    return sums


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte run: a polynomial over coded bytes, taken from prefix sums, then scrambled."""
    if sums is None:
        sums = hash_sums(data, table)
    return mix((sums[ends] - sums[starts]) * _power(len(data))[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) of all rows, and each row's first word.

    ``at`` starts at 0 and ends at ``len(data)``. A long text is taken in pieces that end at white space.
    """
    n, parts, found = len(data), [], []
    cut = 0
    while cut < n:
        end = n
        if n - cut > 2 * CHUNK:
            gap = np.flatnonzero(SPACE[data[cut + CHUNK // 2 : cut + CHUNK]])
            end = cut + CHUNK // 2 + int(gap[-1]) + 1 if len(gap) else n
            if not len(gap):
                rest = np.flatnonzero(SPACE[data[cut + CHUNK :]])
                end = cut + CHUNK + int(rest[0]) + 1 if len(rest) else n
        piece = data[cut:end]
        s, e = spans_of(~SPACE[piece], at[(at >= cut) & (at < end)] - cut)
        parts.append(run_hashes(piece, s, e))
        found.append(s + cut)
        cut = end
    starts = np.concatenate(found) if found else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.searchsorted(starts, at)
