"""Vectorised word and window hashes over the UTF-8 bytes of whole Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is hashed alone. Bounds the temporary arrays.
SLICE_BYTES = 1 << 18
#: Words of more bytes are hashed by a cryptographic digest: sums of products modulo 2^64 coincide for long structured strings.
LONG_WORD = 128
#: Bytes over which sums of products run: bounds the arrays for a text of any length.
BLOCK_BYTES = 1 << 17

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(1 << 18, 1 << max(0, n - 1).bit_length()) + 1)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets of rows and end) for slices of about SLICE_BYTES; null counts as empty."""
    col = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_table(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row and the end the index of its first word. Words end with their row."""
    m = is_word[data]
    if not len(m):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(m) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(m), bool)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(len(m), bool)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes. data is already in lower case if that is wanted."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, i, values = np.empty(len(starts), np.uint64), 0, byte_values(seed)
    while i < len(starts):  # the words that begin within one block; a hash does not depend on where that begins
        at = int(starts[i])
        j = int(np.searchsorted(starts, at + BLOCK_BYTES))
        s, e = starts[i:j] - at, np.minimum(ends[i:j], starts[i:j] + LONG_WORD) - at
        part = data[at : at + int(e[-1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers(_MULT, len(part)), out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * powers(_MULT_INV, len(part))[s] + (e - s).astype(np.uint64))
        i = j
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, begin): all words one after another, each followed by one space, and where in that each begins, and its end."""
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    at = np.arange(int(sizes.sum()))
    before = np.cumsum(sizes) - sizes
    out[at + np.repeat(np.arange(len(sizes)), sizes)] = data[at + np.repeat(starts - before, sizes)]
    return out, begin


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes (the caller drops those that cross rows)."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    factor = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    out = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out += w[i : len(w) - k + 1 + i] * factor[i]
    return mix(out)
