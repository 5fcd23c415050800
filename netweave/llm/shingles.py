"""Sets of hashed word shingles of whole batches of texts, in numpy on their UTF-8 bytes.

A word's hash is a polynomial in its bytes, taken from one running sum over the text, so that neither words nor
texts become Python objects. A shingle's hash is a linear form of its words' mixed hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes, and shingles, that a pass over a batch handles at once.
CHUNK = 1 << 18
_K, _R, _SHORT = np.uint64(0x9E3779B97F4A7C15), 0xD1342543DE82EF95, np.uint64(0xA0761D6478BD642F)
_INVERSE = pow(_R, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte; capital letters have their small ones'.
_LETTER = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _K))
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_SPACE] = 0
_FACTORS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * _K) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_R, CHUNK), np.append(np.uint64(1), _powers(_INVERSE, CHUNK - 1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, the place where each begins and the last one ends); a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about CHUNK bytes of text, or one longer text, so that a worker's memory stays small."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(sizes):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, the first word of each text and the end of the last one's)."""
    space = _SPACE[raw]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    begins, ends = bounds[:-1][bounds[:-1] < len(raw)], bounds[1:][bounds[1:] > 0] - 1
    first[begins], last[ends] = ~space[begins], ~space[ends]
    at, after = np.flatnonzero(first), np.flatnonzero(last) + 1
    return run_hashes(lambda a, b: _LETTER[raw[a:b]], at, after), np.searchsorted(at, bounds)


def run_hashes(numbers: Callable[[int, int], np.ndarray], at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The polynomial hash of each run of places at[k] to after[k], ascending; ``numbers`` gives the 64-bit numbers of a stretch of places."""
    powers, inverse = _tables()
    out, k = np.empty(len(at), np.uint64), 0
    while k < len(at):
        base = at[k]
        stop = max(k + 1, int(np.searchsorted(after, base + CHUNK, side="right")))
        span = int(after[stop - 1] - base)
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(numbers(base, base + span) * (powers[:span] if span <= CHUNK else _powers(_R, span)), out=total[1:])
        out[k:stop] = (total[after[k:stop] - base] - total[at[k:stop] - base]) * inverse[at[k:stop] - base]
        k = stop
    return out


def sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between places, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, ascending, text after text; where each text's begin and the last one's end).

    A text of fewer than WORDS words, but not none, has its whole sequence as one shingle.
    """
    h, first = word_hashes(*text_bytes(column))
    h = mixed(h)
    count = np.diff(first)
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    places = np.append(0, np.cumsum(n))
    out = np.empty(places[-1], np.uint64)
    windows = max(len(h) - WORDS + 1, 0)
    valid = np.ones(windows, bool)  # those that lie in one text
    for j in range(1, WORDS):
        over = first[1:] - j
        valid[over[(over >= 0) & (over < windows)]] = False
    short = np.flatnonzero((count > 0) & (count < WORDS))
    target, done = (np.flatnonzero(np.repeat(count >= WORDS, n)) if len(short) else None), 0
    for begin in range(0, windows, CHUNK):
        end = min(begin + CHUNK, windows)
        total = h[begin:end] * _FACTORS[0]
        for j in range(1, WORDS):
            total += h[begin + j : end + j] * _FACTORS[j]
        total = total[valid[begin:end]]
        out[slice(done, done + len(total)) if target is None else target[done : done + len(total)]] = total
        done += len(total)
    if len(short):
        total = count[short].astype(np.uint64) * _SHORT
        for j in range(WORDS - 1):
            own = count[short] > j
            total[own] += h[first[short[own]] + j] * _FACTORS[j]
        out[places[short]] = total
    out = mixed(out)
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[places[:-1][n > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[places]


def identities(own: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set, 64 bits each."""
    return sums(mixed(own * _K), places).view(np.int64), sums(mixed(mixed(own + _K) * _K), places).view(np.int64)
