"""Vectorised work on the bytes of a batch of texts: words, rolling hashes, Arrow columns."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_limited: list[bool] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def one_thread() -> None:
    """Keep numpy's matrix products in this task to one thread: tasks fill an executor's cores already, and more threads only wait for each other."""
    if TaskContext.get() is None or _limited:
        return
    _limited.append(True)
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 .. n and those of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE_BYTES + (PIECE_BYTES >> 2))
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a finaliser of xor-shifts and multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data))
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _LANES[63])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of whole documents: first row, end row, their bytes, offsets from 0."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in each document, and the index of the first word of each document (one more at the end)."""
    inside = ~outside[data]
    first = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        edges = at[:-1][(at[:-1] < len(data))]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        last[ends] = inside[ends]
    else:
        last = first
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of word, one for each place where k fit."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += word[i : i + n] * _LANES[i]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start .. start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
