"""Hashes of the words of whole columns of texts, without a Python step for each word.

A word's hash is a polynomial in its bytes' values, taken from running sums over a stretch of text, so one pass of
array operations hashes all words of a stretch. It depends on the word alone. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at once; bounds memory, and keeps the running sums in the processor's cache.
PIECE = 1 << 16
#: Longer words are hashed by themselves.
LONG_WORD = 1 << 14

# What the polynomial is of, the finalizer's multipliers, and the white space that separates words.
_BASE = 0x9E3779B97F4A7C15
_FINAL = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SPACES = b" \t\n\x0b\x0c\r"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_FINAL[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_FINAL[1])
    return h ^ (h >> np.uint64(31))


def separating(are: bytes) -> bytes:
    """A table of bytes: 1 for those that separate words, else 0."""
    return bytes(int(c in are) for c in range(256))


WHITE = separating(SPACES)
_LOWER = bytes(range(256)).lower()


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _alone(word: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(word.tobytes().lower())


def _separated(b: np.ndarray, separates: bytes) -> np.ndarray:
    return np.frombuffer(b.tobytes().translate(separates), bool)


def _piece(b: np.ndarray, bounds: np.ndarray, separates: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of b, which has no more than PIECE bytes, and their starts; words end at bounds."""
    own = b.tobytes()
    gap = np.ones(len(b) + 2, bool)  # one before and one after
    gap[1:-1] = np.frombuffer(own.translate(separates), bool)
    starts, ends = gap[:-2].copy(), gap[2:].copy()
    starts[bounds[bounds < len(b)]] = True
    ends[bounds[bounds > 0] - 1] = True
    inner = ~gap[1:-1]
    starts, ends = np.flatnonzero(starts & inner), np.flatnonzero(ends & inner) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.zeros(len(b) + 1, np.uint64)
    values = np.frombuffer(own.translate(_LOWER), np.uint8).astype(np.uint64)
    values *= _UP[: len(b)]
    np.cumsum(values, out=sums[1:])
    size = ends - starts
    h = mix((sums[ends] - sums[starts]) * _DOWN[starts] + size.astype(np.uint64))
    if len(b) > LONG_WORD:
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = _alone(b[starts[i] : ends[i]])
    return h, starts


def _long(b: np.ndarray, separates: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, piece by piece; pieces end where words do."""
    out, i, none = [], 0, np.zeros(0, np.int64)
    while i < len(b):
        j = min(len(b), i + PIECE)
        if j < len(b):
            gaps = np.flatnonzero(_separated(b[i:j], separates))
            if len(gaps):
                j = i + int(gaps[-1]) + 1
            else:
                while j < len(b) and not len(gaps := np.flatnonzero(_separated(b[j : j + PIECE], separates))):
                    j = min(len(b), j + PIECE)
                j += int(gaps[0]) if j < len(b) else 0
        out.append(np.array([_alone(b[i:j])], np.uint64) if j - i > PIECE else _piece(b[i:j], none, separates)[0])
        i = j
    return np.concatenate(out)


def hashed_words(column: pa.Array, separates: bytes = WHITE) -> Iterator[np.ndarray]:
    """For each text of a string or binary column, its words' hashes in order, A-Z lower-cased; none for null."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    if not n:
        return
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    null, nothing = column.is_null().to_numpy(zero_copy_only=False), np.zeros(0, np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if at[j] - at[i] > PIECE:  # one long text
            yield nothing if null[i] else _long(data[at[i] : at[j]], separates)
        else:
            bounds = at[i : j + 1] - at[i]
            h, starts = _piece(data[at[i] : at[j]], bounds, separates)
            cuts = np.searchsorted(starts, bounds)
            for k in range(j - i):
                yield nothing if null[i + k] else h[cuts[k] : cuts[k + 1]]
        i = j
