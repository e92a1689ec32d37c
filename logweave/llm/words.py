"""Words of whole texts as 64-bit hashes, an Arrow column at a time.

A word's hash sums a random number per byte times an odd number per place, and mixes the sum
with the length. A-Z count as a-z unless told otherwise. Two words are taken for one only if 64 bits meet.
"""

from __future__ import annotations

import numpy as np

_K = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1_000_000       # bytes hashed at a time
_EXACT = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _EXACT.copy()
_BYTE[65:91] = _BYTE[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _K
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_PLACE = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


def byte_class(*ranges) -> np.ndarray:
    """Which byte values lie in the given (first, last) ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its texts; a null is an empty text."""
    import pyarrow as pa

    col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, bounds, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(bounds, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def spans(data: np.ndarray, bounds: np.ndarray, word: np.ndarray, between: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``word`` bytes; a text's end ends its last word. Runs are
    also cut where a byte of one class of ``between`` meets one of the other."""
    w = word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    a, b = bounds[:-1][bounds[:-1] < len(w)], bounds[1:][bounds[1:] > 0] - 1
    first[a], last[b] = w[a], w[b]
    if between:
        x, y = between[0][data], between[1][data]
        cut = (x[:-1] & y[1:] | y[:-1] & x[1:]) & w[:-1] & w[1:]
        first[1:] |= cut
        last[:-1] |= cut
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span; without ``fold`` A-Z and a-z differ."""
    table = _BYTE if fold else _EXACT
    out = np.empty(len(start), np.uint64)
    size = end - start
    ahead = np.concatenate([[0], np.cumsum(size)])
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            e = max(a + 1, int(np.searchsorted(ahead, ahead[a] + _STEP, "right")) - 1)
            n = size[a:e]
            at = ahead[a:e] - ahead[a]
            place = np.arange(ahead[e] - ahead[a]) - np.repeat(at, n)
            byte = data[place + np.repeat(start[a:e], n)]
            times = _PLACE[place] if n.max() <= len(_PLACE) else mix((place + 1).astype(np.uint64)) | np.uint64(1)
            out[a:e] = mix(np.add.reduceat(table[byte] * times, at) + n.astype(np.uint64) * _K)
            a = e
    return out


def slices(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text alone."""
    out, a = [], 0
    while a < len(bounds) - 1:
        e = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        out.append((a, e))
        a = e
    return out
