"""Hash values of words and of runs of words, for many texts at a time."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
_BYTES |= np.uint64(1)
PIECE = 4 << 20  # bytes hashed at a time


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept between calls."""
    if len(_POWERS[0]) < count:
        size = max(count, 1 << 20)
        for at, base in enumerate((MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:count], _POWERS[1][:count]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes between each start and end, both ascending; equal bytes, equal values."""
    found = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + PIECE, side="right"))
        last = max(last, first + 1)
        piece = data[starts[first] : ends[last - 1]]
        begin, close = starts[first:last] - starts[first], ends[first:last] - starts[first]
        ahead, back = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * ahead[: len(piece)], out=sums[1:])
        length = (close - begin).astype(np.uint64)
        found[first:last] = mix((sums[close] - sums[begin]) * back[begin] + length * _MIX1)
        first = last
    return found


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words between ASCII white space begin and end, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    begins, closes = bounds[:-1][filled], bounds[1:][filled] - 1
    starts[begins] = inside[begins]
    last[closes] = inside[closes]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(last) + 1, np.searchsorted(at, bounds)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring values, in order."""
    count = len(values) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for at in range(size):
        total = mix(total + values[at : at + count] + np.uint64((at + 1) * int(MULTIPLIER) % (1 << 64)))
    return total


class RollingHash:
    """Two independent hashes of any stretch of some bytes, from sums up to every place."""

    def __init__(self, data: np.ndarray) -> None:
        ahead, self.back = _powers(len(data) + 1)
        self.sums = []
        for table in (_BYTES, mix(_BYTES)):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * ahead[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        length = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * self.back[starts] + length * _MIX2)

    def every(self, size: int) -> np.ndarray:
        """The first hash of all stretches of ``size`` bytes."""
        sums = self.sums[0]
        count = max(len(sums) - size, 0)
        return mix((sums[size : size + count] - sums[:count]) * self.back[:count])
