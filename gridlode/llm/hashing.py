"""Vectorised reading of text columns: bytes, words and 64-bit hashes of words, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20_240_101)
#: A random odd number per byte value and a random odd base: words hash as polynomials modulo 2**64.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[LOWER]
#: For hash_words, to tell A-Z from a-z.
WHOLE_BYTE = _BYTE

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept between calls up to a chunk."""
    if not _powers or len(_powers[0]) < min(n, _CHUNK):
        _powers[:] = _power_table(_CHUNK)
    return tuple(_powers) if n <= _CHUNK else _power_table(n)


def _power_table(n: int) -> list[np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        x = np.full(n, U(b & 0xFFFFFFFFFFFFFFFF))
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (UTF-8) or binary column, end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row where its words begin (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    edge = first[:-1].copy()
    edge[1:] |= ~word[:-1]
    starts = np.flatnonzero(word & edge)
    edge = first[1:].copy()
    edge[:-1] |= ~word[1:]
    edge[-1] = True
    ends = np.flatnonzero(word & edge) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _LOWER_BYTE) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], lower-cased unless values says else, a chunk of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _PLACE[0])
        i = j
    return out


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; shorter by n - 1 than words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - n + 1] * _PLACE[1]
    for k in range(1, n):
        total = total + words[k : len(words) - n + 1 + k] * _PLACE[k + 1]
    return mix(total)


def hash_sequence(words: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words as a whole."""
    total = U(0)
    with np.errstate(over="ignore"):
        for k, w in enumerate(words):
            total = total + w * _PLACE[20 + k % 40]
        total = total + U(len(words)) * _PLACE[0]
    return mix(np.array([total], np.uint64))[0]


def pieces(batches, text: str = "text", most: int = 2 << 20, rows: int = 1 << 20):
    """Arrow batches again, cut so that each has at most `rows` rows and texts of about `most` bytes, or one row."""
    for batch in batches:
        at = text_bytes(batch.column(batch.schema.get_field_index(text)))[1]
        i = 0
        while i < len(batch):
            j = min(len(batch), max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
            j = min(j, i + rows)
            yield batch.slice(i, j - i)
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
