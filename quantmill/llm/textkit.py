"""Vectorised word hashing over Arrow binary or string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes, with A-Z
lower-cased: the byte form of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on
lower-cased text. Work runs in blocks of about a megabyte, so that memory follows the
number of words and a very long text needs no more than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_codes = np.arange(256, dtype=np.uint8)
UPPER = (_codes >= 65) & (_codes <= 90)
LOWER = np.where(UPPER, _codes + 32, _codes).astype(np.uint8)
DIGIT = (_codes >= 48) & (_codes <= 57)
WORD = UPPER | DIGIT | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)
LOWER_64 = LOWER.astype(np.uint64) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_2
    return h ^ (h >> np.uint64(33))


def _power(n: int, base: np.uint64) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n > 4 * BLOCK:
            return table
        _powers[key] = table
    return _powers[key]


def as_binary(column: pa.Array) -> pa.Array:
    """The bytes of a string column (its own buffers, without a copy unless there are nulls); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return pc.fill_null(column, b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a binary or string column; nulls are empty."""
    column = as_binary(column)
    wide = pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def ranges(offsets: np.ndarray, most_bytes: int = 2 * BLOCK, most_rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded bytes and rows; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi
        lo = hi


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
    """Where a block that starts at `at` may end without cutting a word."""
    stop = at + BLOCK
    if stop >= end:
        return end
    row = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
    gaps = np.flatnonzero(~WORD[data[max(at, stop - 4096) : stop]])
    if len(gaps):
        return max(row, max(at, stop - 4096) + int(gaps[-1]) + 1)
    if row > at:
        return row
    after = int(offsets[np.searchsorted(offsets, stop, side="right")])
    while stop < after:
        gaps = np.flatnonzero(~WORD[data[stop : min(stop + BLOCK, after)]])
        if len(gaps):
            return stop + int(gaps[0]) + 1
        stop = min(stop + BLOCK, after)
    return after


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each row's words begin (n+1)."""
    at, end = int(offsets[0]), int(offsets[-1])
    hashes, starts = [], []
    while at < end:
        stop = _cut(data, offsets, at, end)
        block = data[at:stop]
        is_word = WORD[block]
        first, last = is_word.copy(), is_word.copy()
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        inner = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, stop, side="left")] - at
        first[inner] = is_word[inner]
        last[inner - 1] = is_word[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            sums = np.cumsum(LOWER_64[block] * _power(len(block), BASE)[: len(block)], dtype=np.uint64)
            before = np.where(s > 0, sums[s - 1], np.uint64(0))
            h = (sums[e] - before) * _power(len(block), BASE_INVERSE)[s]
            hashes.append(mix(h + (e - s + 1).astype(np.uint64) * MIX_2))
            starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def word_hash(word: bytes) -> int:
    """The hash that words() gives this word (which must be one word)."""
    h, _ = words(np.frombuffer(word, np.uint8), np.array([0, len(word)], np.int64))
    if len(h) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(h[0])


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words; a row of fewer, but not none, has one shingle.

    Returns the hashes in order and where each row's begin (n+1).
    """
    n_words = np.diff(first)
    per_row = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    row = np.repeat(np.arange(len(n_words)), per_row)
    at = first[:-1][row] + np.arange(len(row)) - begin[:-1][row]
    size = np.minimum(n_words, k)[row]
    out = size.astype(np.uint64) * MIX_1
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for i in range(k):
        out = np.where(i < size, mix(out * BASE + padded[at + i] + np.uint64(i)), out)
    return out, begin
