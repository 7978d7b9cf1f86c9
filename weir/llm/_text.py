"""Vectorised work on batches of UTF-8 text: word hashes, shingle sets, row blocks.

Texts arrive as Arrow string columns; everything here works on their one byte
buffer, a few megabytes at a time, so memory follows the block and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once. Temporaries take about 40 times as much.
BLOCK = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_POWERS = np.array([1], dtype=np.uint64)

#: Bytes of words between blanks: all but space and 09-0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of ASCII letters, digits and everything beyond ASCII (after lower-casing A-Z).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _STEP
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 64) - 1, _STEP, np.uint64))]).astype(np.uint64)
    return _POWERS


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string or binary column; a null has no bytes."""
    arr = batch.column(batch.schema.get_field_index(name))
    return buffers(arr)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = np.asarray(arr.is_null())
    if null.any():
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], null


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _pieces(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK that end where a word can't go on."""
    at, n = 0, len(data)
    while at < n:
        end = at + BLOCK
        if end >= n:
            end = n
        else:
            k = int(np.searchsorted(offsets, end, side="right")) - 1
            gaps = np.flatnonzero(~keep[data[max(at, end - 4096) : end]])
            if offsets[k] > at + BLOCK // 2:
                end = int(offsets[k])
            elif len(gaps):
                end = max(at, end - 4096) + int(gaps[-1]) + 1
            else:
                while end < n and keep[data[end]] and end != offsets[min(k + 1, len(offsets) - 1)]:
                    end += 1
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows: (64-bit hashes after lower-casing A-Z, first byte of each, first word of each row and the end)."""
    hashes, starts = [], []
    for a, b in _pieces(data, offsets, keep):
        d = data[a:b]
        is_word = keep[d]
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[rows] = is_word[rows]
        at = np.flatnonzero(first)
        if not len(at):
            continue
        d, base = d[at[0] :], at - at[0]
        place = np.arange(len(d), dtype=np.int64) - np.repeat(base, np.diff(np.append(base, len(d))))
        on = is_word[at[0] :]
        value = _VALUE[d] * _powers(int(place[on].max()) + 1)[np.where(on, place, 0)]
        value[~on] = 0
        hashes.append(mix(np.add.reduceat(value, base)))
        starts.append(at + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.searchsorted(start, offsets)


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; the whole sequence is one where it is shorter; none without words."""
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(3) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
