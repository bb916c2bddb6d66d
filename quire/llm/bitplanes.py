"""Many Hamming distances at once, on vertically stored bit planes."""

from __future__ import annotations

import numpy as np


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(n, lanes) unsigned 64-bit fingerprints as bit planes: row p holds bit p of all n, 64 to a word, one spare word."""
    n, lanes = prints.shape
    words = n // 64 + 2
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, lanes * 8), axis=1, bitorder="little")
    padded = np.zeros((lanes * 64, words * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in each of the 64 places of a word."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


class Counters:
    """One bit-sliced counter for each lane; counts beyond what the radius needs are held as "over"."""

    def __init__(self, words: int, radius: int):
        self.radius = radius
        self.low = [np.zeros(words, dtype=np.uint64) for _ in range(3)]
        self.high = [np.zeros(words, dtype=np.uint64) for _ in range(max(0, radius.bit_length() - 3))]
        self.over = np.zeros(words, dtype=np.uint64)

    def add_eight(self, x: np.ndarray) -> None:
        ones, twos, fours = self.low
        ones, a = _csa(ones, x[0], x[1])
        ones, b = _csa(ones, x[2], x[3])
        twos, c = _csa(twos, a, b)
        ones, a = _csa(ones, x[4], x[5])
        ones, b = _csa(ones, x[6], x[7])
        twos, d = _csa(twos, a, b)
        fours, carry = _csa(fours, c, d)
        self.low = [ones, twos, fours]
        for i, counter in enumerate(self.high):
            self.high[i], carry = counter ^ carry, counter & carry
        self.over |= carry

    def exceeded(self) -> np.ndarray:
        """Lanes whose count is over the radius."""
        more, same = self.over.copy(), ~self.over
        counters = self.low + self.high
        for i in reversed(range(len(counters))):
            if self.radius >> i & 1:
                same &= counters[i]
            else:
                more |= same & counters[i]
                same &= ~counters[i]
        return more

    def keep(self, words: np.ndarray) -> None:
        self.low, self.high = [x[words] for x in self.low], [x[words] for x in self.high]
        self.over = self.over[words]


def close_pairs(prints: np.ndarray, ends: np.ndarray, radius: int):
    """Yield (i, j) index arrays of pairs i < j < ends[i] that differ in at most ``radius`` bits.

    ``ends[i]`` is where i's bucket ends. One step compares every row with the one d places on: the planes are shifted by
    d lanes, eight planes at a time run through carry-save adders, and words of 64 lanes in which all distances are over
    the radius are abandoned.
    """
    n = len(prints)
    if n < 2:
        return
    planes, one = planes_of(prints), np.uint64(1)
    reach = ends - np.arange(n)  # partners within reach, and one more
    for d in range(1, int(reach.max())):
        at, by = divmod(d, 64)
        wanted = np.zeros((planes.shape[1] - 2) * 64 + 64, dtype=np.uint8)
        wanted[:n] = reach > d
        alive = np.packbits(wanted, bitorder="little").view(np.uint64)
        words = np.flatnonzero(alive)
        alive, counters = alive[words], Counters(len(words), radius)
        for p in range(0, len(planes), 8):
            here = planes[p : p + 8]
            moved = here[:, words + at]
            if by:
                after = np.minimum(words + at + 1, planes.shape[1] - 1)
                moved = (moved >> np.uint64(by)) | (here[:, after] << np.uint64(64 - by))
            counters.add_eight(here[:, words] ^ moved)
            alive = alive & ~counters.exceeded()
            live = np.flatnonzero(alive)
            if len(live) < len(words):
                words, alive = words[live], alive[live]
                counters.keep(live)
            if not len(words):
                break
        if len(words):
            word, lane = np.nonzero((alive[:, None] >> np.arange(64, dtype=np.uint64)) & one)
            i = words[word] * 64 + lane
            yield i, i + d
