"""Sets of hashed word shingles, for whole Arrow batches at once.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case; a text's set holds its distinct runs of
``SIZE`` words, or the whole sequence where there are fewer, and nothing without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _SALTS[0]
    x = (x ^ (x >> np.uint64(27))) * _SALTS[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for at least n places."""
    if len(_powers["up"]) < n:
        inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
        for key, base in (("up", int(_MULTIPLIER)), ("down", inverse)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _powers[key] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many stand before each bound; bounds: where texts begin, and the end."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    data = _LOWER[data]
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _SALTS[2])
    return words, np.searchsorted(starts, bounds)


def _hashed(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The shingle hashes of each text, in order of place."""
    words, counts = _word_hashes(data, bounds)
    runs = np.empty(0, np.uint64)
    if len(words) >= SIZE:
        m = len(words) - SIZE + 1
        runs = words[:m] * _SALTS[0]
        for k in range(1, SIZE):
            runs = runs + words[k : k + m] * _SALTS[k]
        runs = mix(runs)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= SIZE:
            out.append(runs[a : b - SIZE + 1].view(np.int64))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole * _SALTS[3] + w], np.uint64))[0]
            out.append(np.array([whole], np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offsets


def sequences(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingle hashes of each text of a column in order of place, repeats included."""
    data, offsets = texts_of(column)
    with np.errstate(over="ignore"):
        for lo, hi in _slices(offsets):
            at = offsets[lo : hi + 1]
            yield from _hashed(data[at[0] : at[-1]], at - at[0])


def words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of a column in order of place."""
    data, offsets = texts_of(column)
    with np.errstate(over="ignore"):
        for lo, hi in _slices(offsets):
            at = offsets[lo : hi + 1]
            hashes, counts = _word_hashes(data[at[0] : at[-1]], at - at[0])
            for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
                yield hashes[a:b]


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for x in sequences(column):
        yield np.unique(x)


def set_hash(hashes: np.ndarray, other: bool = False) -> int:
    """One hash of a whole set, or another one."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64)
        a, b = (_SALTS[1], _SALTS[0]) if other else (_SALTS[3], _SALTS[4])
        total = np.add.reduce(mix(x * a + b)) + np.uint64(len(x)) * _SALTS[2]
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])
