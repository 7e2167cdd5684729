"""Vectorised helpers that run inside Spark tasks over Arrow batches of text.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR, which on UTF-8 is the same as the run of
characters outside them.  Hashes are polynomial over the word's bytes, finished with an avalanche step; equal words
have equal hashes on every executor, whatever batch they came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the temporary arrays (about 40 bytes for each byte of text).
SLICE_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept between calls, grown by doubling)."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("up", _P), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a splitmix generator: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts at once.

    ``data``: the joined bytes; ``start``/``end``: byte bounds of each word; ``doc``: index of its text;
    ``first``: for each text the index of its first word, with one entry more at the end.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = bounds[1:-1][bounds[1:-1] < n]
        begins[cut] = inside[cut]
        stops = np.zeros(n + 1, bool)
        stops[1:] = inside
        stops[:-1] &= ~inside
        stops[cut] |= inside[cut - 1] if len(cut) else False
        stops[0] = False
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.inside = inside

    def hashes(self, table: np.ndarray | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word (or of each given byte range), after ``table`` maps the bytes, if given."""
        start, end = self.start if start is None else start, self.end if end is None else end
        up, down = _power(len(self.data) + 1)
        data = self.data if table is None else table[self.data]
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive entries (runs over text borders too; the caller drops those)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            out *= np.uint64(_P)
            out += hashes[k : len(hashes) - width + 1 + k]
    return mix(out)


def word_hash(word: bytes) -> int:
    """The hash that :class:`Words` gives this word; for small driver-side word lists."""
    total, power = 0, 1
    for b in word:
        total, power = (total + (b + 1) * power) & _M64, power * _P & _M64
    return int(mix(np.array([(total + len(word)) & _M64], np.uint64))[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a string or binary column with their joined bytes and bounds, about ``limit`` bytes at once.

    Null texts count as empty.  One text longer than the limit makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each half-open range between neighbouring bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
