"""Vectorised word and shingle hashes over the UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Its hash is the sum, modulo 2**64, of one
mixed 64-bit value for each of its bytes and its place in the word, taken from prefix sums over blocks, so no Python object is
made for a word. (A polynomial modulo 2**64 would do without the places, but words built by doubling collide for any base.) Bytes
above 0x7F are never separators, therefore words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 19
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[65:91] += np.uint64(32)
#: One odd multiplier for each place of a shingle.
_PLACE = [(_R * 0xD1342543DE82EF95 ** (k + 1)) & _MASK | 1 for k in range(16)]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * _R + _R) & _MASK)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, a null being an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes, or of one longer row: what is worked on at once stays small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, row after row, and where each row's words begin (one more entry than rows). separators: by byte, whether it
    separates words; WORD_SIGNS leaves words of letters, digits and characters beyond ASCII."""
    base = int(offsets[0])
    text, cuts = data[base : int(offsets[-1])], offsets - base
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[cuts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    inside_word = inside.copy()
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out, i = np.empty(len(s), np.uint64), 0
    while i < len(s):
        low = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, low + _BLOCK, side="right")))
        high = int(e[j - 1])
        size = e[i:j] - s[i:j]
        begin = np.cumsum(size) - size
        place = np.arange(begin[-1] + size[-1]) - np.repeat(begin, size)  # of each byte in its word
        byte = _CODE[text[low:high]][inside_word[low:high]]
        out[i:j] = np.add.reduceat(mix(place.astype(np.uint64) << np.uint64(9) | byte), begin)
        i = j
    return out, np.searchsorted(s, cuts)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row, row after row, with repeats; a row of fewer words has one of all its words, a row
    without words has none. Second: where each row's begin."""
    many = np.diff(first)
    count = np.where(many >= width, many - width + 1, np.minimum(many, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not len(words):
        return np.zeros(0, np.uint64), begin
    # a row's last places wrap into words of other rows; those sums are not picked
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    row = np.repeat(np.arange(len(many)), many)
    left = first[1:][row] - np.arange(len(words))  # words from here to the end of the row
    for k in range(width):
        part = padded[k : k + len(words)] * np.uint64(_PLACE[k])
        total += part if k == 0 else np.where(left > k, part, 0)
    pick = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    return mix(total[pick], width), begin
