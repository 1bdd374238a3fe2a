"""Vectorised text kernels in numpy over the concatenated UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def byte_keys(seed: int) -> np.ndarray:
    """A random 64-bit key for each byte, the same on every machine."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins and the last one ends; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary()
    if len(column) == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x moved left, zeros behind it."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """The hash of values[i : i + size] at each i (those that run over the end are of no use), by doubling."""
    power, whole, done = {1: values}, None, 0
    span = 1
    while span * 2 <= size:
        power[span * 2] = power[span] * U64(pow(BASE, span, 1 << 64)) + shifted(power[span], span)
        span *= 2
    for span in sorted(power, reverse=True):
        if size & span:
            part = shifted(power[span], done) if done else power[span]
            whole = part if whole is None else whole * U64(pow(BASE, span, 1 << 64)) + part
            done += span
    return mix(whole)


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """BASE to the powers from 0 to n, kept by the worker for the next text up to a bound."""
    global _POWERS
    if n < len(_POWERS):
        return _POWERS[: n + 1]
    out = np.full(n + 1, BASE, U64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if n <= 8 << 20:
        _POWERS = out
    return out


class Spans:
    """Hashes of any spans of a byte array, by sums of keyed powers; a span's hash depends on its bytes alone."""

    def __init__(self, data: np.ndarray, seed: int):
        self.n = len(data)
        self.power = powers(self.n)
        self.sums = np.zeros(self.n + 1, U64)
        keyed = byte_keys(seed)[data]
        keyed *= self.power[:-1]
        np.cumsum(keyed, out=self.sums[1:])
        self.scale = U64(pow(BASE_INV, self.n, 1 << 64))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.power[self.n - start] * self.scale + (end - start).astype(U64))


def sums_at(values: np.ndarray, offsets: np.ndarray, kind=np.int64) -> np.ndarray:
    """The sum of values in each row's range."""
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[offsets[1:]] - total[offsets[:-1]]


#: White space between words: a space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | first[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | first[1:-1]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(offsets, begins, "right") - 1


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[:-1] | same[1:]
    return out
