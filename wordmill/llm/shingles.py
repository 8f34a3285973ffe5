"""Word and shingle hashes of many texts at once, straight from Arrow string buffers.

A text's words are hashed without making Python strings: every byte is
multiplied by a fixed random number of its place in the word, the products are
summed per word, and the sum is mixed to 64 bits.  Case is folded for A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
# The multipliers of the splitmix64 and murmur3 finalisers.
_STEP, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_F1, _F2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)

PIECE_BYTES = 2_000_000  # texts hashed together


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + _U(1)) * _STEP
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _F1
    x = (x ^ (x >> _U(33))) * _F2
    return x ^ (x >> _U(33))


@lru_cache(maxsize=4)
def _place_numbers(n: int) -> np.ndarray:
    return splitmix(np.arange(n, dtype=_U)) | _U(1)


def place_numbers(n: int) -> np.ndarray:
    return _place_numbers(1 << max(8, int(n - 1).bit_length()))


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(col: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of stretches of about ``most`` bytes (one text at least)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    _, off = string_buffers(col)
    k = 0
    while k < len(col):
        end = max(k + 1, int(np.searchsorted(off, off[k] + most, "right")) - 1)
        yield k, col.slice(k, end - k)
        k = end


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in text order, and the offsets of each text's words in them."""
    data, off = string_buffers(col)
    if not len(data):
        return np.empty(0, _U), np.zeros(len(off), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    firsts = off[:-1][off[:-1] < off[1:]]
    begin[firsts] = ~space[firsts]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(off), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    place = np.arange(len(data), dtype=np.int32)
    lengths = np.diff(np.append(starts, len(data)))
    place[starts[0]:] -= np.repeat(starts.astype(np.int32), lengths)
    place[space] = 0
    terms = place_numbers(int(place.max()) + 1)[place]
    terms *= low.astype(_U) + _U(1)
    terms[space] = 0
    return mix(np.add.reduceat(terms, starts)), np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``k``-word shingles, in order, and their offsets.

    A text with 1 to k-1 words has one shingle: its whole sequence.
    """
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(offsets[-1], _U)
    full = np.repeat(n >= k, count)
    # Place of each shingle's first word.
    at = np.repeat(off[:-1], count) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    if full.any():
        out[full] = chain(words, at[full], k)
    for m in range(1, k):
        short = np.repeat(n == m, count)
        if short.any():
            out[short] = chain(words, at[short], m)
    return out, offsets


def chain(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on."""
    h = np.full(len(at), k, _U) * _STEP
    for j in range(k):
        h = (h ^ words[at + j]) * _F1
        h ^= h >> _U(29)
    return mix(h)


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other."""
    for _, some in pieces(col):
        h, off = shingle_hashes(*word_hashes(some), k)
        for a, b in zip(off[:-1], off[1:], strict=True):
            yield np.unique(h[a:b])
