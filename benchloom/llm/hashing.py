"""Vectorised hashes of words, grams and windows, modulo 2**64, and sliding minima."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes that are hashed at a time, so that work arrays stay in cache.
SLICE = 1 << 19
#: The low bits of a sliding-minimum key hold a position, the others the top bits of a hash.
POS_BITS = 28
POS_MASK = U64((1 << POS_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def noise(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mixed(mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


BYTE_NOISE = noise(256, 1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of an odd base and of its inverse, grown when asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


POWERS = (Powers(0x9E3779B97F4A7C15 | 5), Powers(0xC2B2AE3D27D4EB4F))


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums for spans(): one longer than values."""
    up, _ = POWERS[which].get(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, which: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end), equal for equal spans wherever they stand."""
    _, down = POWERS[which].get(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def grams(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of all spans of k values; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    return spans(prefix(values, which), slice(0, n), slice(k, k + n), which)


def least_at(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes, the place of its smallest (top bits), the leftmost of equals."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    low = (hashes & ~POS_MASK) | np.arange(len(hashes), dtype=U64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & POS_MASK).astype(np.int64)


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of all documents; words never cross documents.

    lut: which bytes separate words. Works on slices that end between words, so memory follows the
    slice and the longest word, not the text.
    """
    starts, ends, hashes = [], [], []
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and not (edge[to] or lut[data[to]]):
            end = min(len(data), to + SLICE)
            gap = np.flatnonzero(edge[to:end] | lut[data[to:end]])
            to = to + int(gap[0]) if len(gap) else end
        part, cut = data[at:to], edge[at:to].copy()
        cut[0] = True
        inside = ~lut[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:]
        s = np.flatnonzero(first)
        if len(s):
            last = inside.copy()
            last[:-1] &= ~inside[1:] | cut[1:]
            e = np.flatnonzero(last) + 1
            place = np.arange(len(part), dtype=np.int32)
            origin = np.zeros(len(part), np.int32)
            origin[s] = s
            place -= np.maximum.accumulate(origin)
            weight = noise(int((e - s).max()) + 1, 7) | U64(1)
            value = BYTE_NOISE[part]
            value *= weight[np.minimum(place, len(weight) - 1)]
            value[~inside] = 0
            h = np.add.reduceat(value, s) + (e - s).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mixed(h))
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
