"""Numpy kernels over Arrow text buffers: words, rolling hashes, shingles, sets.

All functions work on one slice of a record batch at a time (see ``slices``), so
the memory of a Python worker is bounded by the slice budget or by the longest
single text, whichever is larger; nothing is truncated.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_ROLL = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_ROLL_INV = pow(_ROLL, -1, 1 << 64)

# The six ASCII white-space bytes of the word contract.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse, for offsets 0..n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        up = np.full(size, _ROLL, dtype=np.uint64)
        down = np.full(size, _ROLL_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers["up"] = np.multiply.accumulate(up)
        _powers["down"] = np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply, two rounds)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw, off = raw[off[0] : off[-1]], off - off[0]
    if column.null_count:  # a null row may own bytes; make it empty
        valid = np.asarray(column.is_valid())
        lengths = np.diff(off)
        if lengths[~valid].any():
            raw = raw[np.repeat(valid, lengths)]
        off = np.concatenate(([0], np.cumsum(np.where(valid, lengths, 0))))
    return raw, off


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES):
    """Row ranges whose texts together stay within the budget (a longer text stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first-word index of every row. Words never cross rows.

    Returns (starts, ends, first) where row i owns words first[i]:first[i+1].
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~WHITE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = np.zeros(n + 1, bool)
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = solid[edges]
    stop[edges] |= solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of data[s:e] for every span, independent of its place."""
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive tokens (length len(tokens) - k + 1, at least 0)."""
    m = len(tokens) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(m, np.uint64), 1
    for j in range(k):
        total += tokens[j : j + m] * np.uint64(factor)
        factor = factor * _ROLL & 0xFFFFFFFFFFFFFFFF
    return mix64(total)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a slice and the first-word index of each row."""
    if lower:
        data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    return (span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def of_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task; functions that travel by value bring no globals that last."""
    module = sys.modules.setdefault("_tidepool_worker", types.ModuleType("_tidepool_worker"))
    if name not in module.__dict__:
        module.__dict__[name] = make()
    return module.__dict__[name]
