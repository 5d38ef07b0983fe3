"""Hashed word shingles of whole texts, vectorised over blocks of documents.

Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D, after A-Z are
lower-cased; a shingle is `k` consecutive words, and a text with fewer words is one shingle."""

from __future__ import annotations

import numpy as np
import xxhash

_RNG = np.random.Generator(np.random.PCG64(20240607))
_PLACES = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Starting values of the two hashes of a run, and masks that keep the first 0..7 bytes of eight.
_SEEDS = _RNG.integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)
#: Longer runs are hashed one at a time.
_LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(data: np.ndarray, blank: np.ndarray, hashes: int = 1) -> tuple[np.ndarray, ...]:
    """Start, end and `hashes` (1 or 2) 64-bit hashes of each run of bytes for which the table
    `blank` is false. A run goes in eight bytes at a time, each step mixing all bits, so that no
    family of runs collides by its form; runs of up to eight bytes of one length never collide. The
    second is of other seeds for runs of over 16 bytes; of shorter ones it holds the last eight
    bytes, so that both together tell runs of one length apart."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~blank[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def mixed(seed: np.uint64, of: np.ndarray) -> np.ndarray:
        begin, left = start[of], size[of]
        value, live = mix(left.astype(np.uint64) * seed), np.arange(len(of))
        while len(live):
            part, n = wide[begin[live]], left[live]
            ends = n < 8
            part[ends] &= _MASKS[n[ends]]
            value[live] = mix(value[live] ^ part)
            begin[live] += 8
            left[live] -= 8
            live = live[n > 8]
        return value

    short = np.flatnonzero(size <= _LONG)
    values = [np.zeros(len(size), np.uint64)]
    values[0][short] = mixed(_SEEDS[0], short)
    if hashes == 2:
        few = size < 8
        other = wide[np.where(few, start, end - 8)]
        other[few] &= _MASKS[size[few]]
        other ^= size.astype(np.uint64) * _SEEDS[1]
        middle = short[size[short] > 16]
        other[middle] = mixed(_SEEDS[1], middle)
        values.append(other)
    for i in np.flatnonzero(size > _LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[i] : end[i]].tobytes())
        for value, part in zip(values, (whole & (1 << 64) - 1, whole >> 64)):
            value[i] = part
    return start, end, *values


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the bytes `data`, and its 64-bit hash."""
    return runs(_LOWER[data], _SPACE)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; none without words."""
    joined = b" ".join(t or b"" for t in texts)
    bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    start, _, value = words(np.frombuffer(joined, np.uint8))
    first = np.searchsorted(start, bounds)
    n = len(value)
    full = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            full[: n - k + 1] += value[j : n - k + 1 + j] * _PLACES[j]
    full = mix(full + np.uint64(k))
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            short = (value[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64)
            s = mix(np.array([short + np.uint64(b - a)], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of distinct numbers."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
