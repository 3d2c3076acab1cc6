"""Vectorised word and shingle hashes over Arrow string buffers.

A word is a run of ASCII letters and digits and of all non-ASCII characters; A-Z count as a-z (callers
lower-case other letters in Spark first). A word's 64-bit hash adds one random table entry for each
(position, byte), so a block of text needs a handful of numpy passes and no Python object a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from turnscope.llm.common import blocks, utf8_buffers

BLOCK_BYTES = 1 << 18
_SPAN = 64

_rng = np.random.Generator(np.random.PCG64(20260101))
_TABLE = _rng.integers(0, 1 << 64, (_SPAN, 256), dtype=np.uint64).ravel()
#: Odd factors for the bytes beyond the first _SPAN of a word.
_FACTORS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROLL = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _letters() -> np.ndarray:
    """Each byte's letter in a word, 0 for a separator."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if byte >= 0x80 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 0x80 else byte
    return table


_LETTER = _letters()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _hash_span(data: np.ndarray, starts_here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of ``data``; a word also ends before each row of starts_here."""
    letter = _LETTER[data]
    inside = letter != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = starts_here[starts_here < len(data)]
    first[rows] = inside[rows]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    chars = letter[inside].astype(np.int32)
    at = np.flatnonzero(first[inside])
    length = np.diff(at, append=len(chars))
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
    value = _TABLE[(place & (_SPAN - 1)) * 256 + chars]
    if length.max() > _SPAN:
        far = np.flatnonzero(place >= _SPAN)
        value[far] *= _FACTORS[(place[far] // _SPAN) % len(_FACTORS)]
    return mix(np.add.reduceat(value, at) + length.astype(np.uint64)), begin


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte counted from offsets[0], each row's first word).

    A long row is taken in spans that end between words, so memory follows the span, not the row.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    hashes, begins, at = [], [], base
    row_starts = offsets[:-1] - base
    while at < end:
        stop = min(at + 4 * BLOCK_BYTES, end)
        while stop < end and _LETTER[data[stop - 1]] and _LETTER[data[stop]]:
            back = np.flatnonzero(_LETTER[data[at:stop]] == 0)
            if len(back):
                stop = at + int(back[-1]) + 1
                break
            stop = min(stop + BLOCK_BYTES, end)
        rows = row_starts[(row_starts >= at - base) & (row_starts < stop - base)] - (at - base)
        h, b = _hash_span(data[at:stop], rows)
        hashes.append(h)
        begins.append(b + (at - base))
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    b = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return h, b, np.searchsorted(b, offsets - base, side="left")


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, word starts, row starts) over blocks of bounded bytes."""
    data, offsets = utf8_buffers(texts)
    for lo, hi in blocks(offsets, BLOCK_BYTES):
        yield lo, hi, *hash_words(data, offsets[lo : hi + 1])


def prefixes(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, rows: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word's first ``least`` to ``most`` bytes, as far as it is that long. ``begin`` and ``rows``
    are those of ``hash_words`` for the same offsets."""
    for at in range(0, len(begin), BLOCK_BYTES >> 2):
        start = begin[at : at + (BLOCK_BYTES >> 2)] + int(offsets[0])
        row = np.searchsorted(rows, np.arange(at, at + len(start)), side="right") - 1
        end = offsets[1:][row]
        total = np.zeros(len(start), np.uint64)
        for k in range(most):
            inside = start + k < end
            start, row, end, total = start[inside], row[inside], end[inside], total[inside]
            letter = _LETTER[data[start + k]]
            inside = letter != 0
            start, row, end = start[inside], row[inside], end[inside]
            total = total[inside] + _TABLE[(k & (_SPAN - 1)) * 256 + letter[inside].astype(np.int64)]
            if k + 1 >= least:
                yield row, mix(total ^ _ROLL[k])


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every run of n bytes inside a word that is not the word's start."""
    base, end = int(offsets[0]), int(offsets[-1])
    for at in range(base, end, BLOCK_BYTES):
        lo = max(at - 1, base)
        span = _LETTER[data[lo : min(at + BLOCK_BYTES + n - 1, end)]]
        count = len(span) - n + 1
        if count <= 0:
            continue
        cut = span == 0
        starts = offsets[(offsets > lo) & (offsets < lo + len(span))] - lo
        cut[starts] = True  # a word ends before each row
        cut[1:] |= span[:-1] == 0
        cut[0] |= lo == base
        crossed = np.cumsum(cut, dtype=np.int32)
        inner = np.flatnonzero((crossed[n - 1 :] == crossed[:count]) & ~cut[:count])
        inner = inner[inner >= at - lo]
        total = np.zeros(len(inner), np.uint64)
        for j in range(n):
            total += _TABLE[j * 256 + span[inner + j].astype(np.int64)]
        yield np.searchsorted(offsets, inner + lo, side="right") - 1, mix(total ^ _ROLL[-1])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, at the place of its first word; len(words) - n + 1 of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count] * _ROLL[0]
    for j in range(1, n):
        total += words[j : j + count] * _ROLL[j]
    return mix(total + np.uint64(n))


def shingles(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-word shingles of every row, row starts). A row of 1 to n-1 words has one shingle, of all its words."""
    count = np.diff(rows)
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    starts = np.concatenate(([0], np.cumsum(number)))
    out = np.zeros(starts[-1], np.uint64)
    runs = ngrams(words, n)
    long = np.flatnonzero(count >= n)
    if len(long):
        take = number[long]
        src = np.repeat(rows[long] - np.concatenate(([0], np.cumsum(take)[:-1])), take) + np.arange(take.sum())
        dst = np.repeat(starts[long] - np.concatenate(([0], np.cumsum(take)[:-1])), take) + np.arange(take.sum())
        out[dst] = runs[src]
    for row in np.flatnonzero((count > 0) & (count < n)):
        own = words[rows[row] : rows[row + 1]]
        out[starts[row]] = ngrams(own, len(own))[0]
    return out, starts
