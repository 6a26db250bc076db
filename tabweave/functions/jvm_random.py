"""Java's and Spark's random numbers, so that samples drawn in Python are those that MLlib draws.

``XORShiftRandom`` is linear in the bits of its state: ``n`` steps are a matrix, so any place of the sequence is reached by a
few matrix products, and a batch of numbers is drawn in lanes side by side.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_WORD, _LONG = (1 << 32) - 1, (1 << 64) - 1
_ARRAY_SEED = 0x3C074A61
#: Steps that one lane takes.
LANE = 512


def _rotated(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & _WORD


def _murmur(data: bytes, seed: int) -> int:
    """Scala's MurmurHash3 of whole words."""
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & _WORD
        h = (_rotated(h ^ (_rotated(k, 15) * 0x1B873593 & _WORD), 13) * 5 + 0xE6546B64) & _WORD
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _WORD
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _WORD
    return h ^ (h >> 16)


def start(seed: int) -> int:
    """State of an ``XORShiftRandom`` of this seed."""
    data = (seed & _LONG).to_bytes(8, "big")
    low = _murmur(data, _ARRAY_SEED)
    return (_murmur(data, low) << 32) | low


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x ^= x >> np.uint64(35)
    x ^= x << np.uint64(4)
    return x


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for b in range(64):
        out ^= matrix[b] * ((x >> np.uint64(b)) & np.uint64(1))
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """Images of the 64 bits after 2^k steps."""
    if k == 0:
        return _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    half = _power(k - 1)
    return _apply(half, half)


def _ahead(x: np.ndarray, steps: int) -> np.ndarray:
    k = 0
    while steps >> k:
        if (steps >> k) & 1:
            x = _apply(_power(k), x)
        k += 1
    return x


def doubles(seed: int, first: int, n: int) -> np.ndarray:
    """Numbers ``first`` to ``first + n`` that ``nextDouble`` of an ``XORShiftRandom`` of this seed gives."""
    lanes = _ahead(np.array([start(seed)], np.uint64), 2 * first)
    while len(lanes) * LANE < 2 * n:
        lanes = np.concatenate([lanes, _ahead(lanes, LANE * len(lanes))])
    lanes = lanes[: -(-2 * n // LANE)]
    out = np.empty((len(lanes), LANE // 2))
    for i in range(LANE // 2):
        lanes = _step(lanes)
        high = lanes & np.uint64((1 << 26) - 1)
        lanes = _step(lanes)
        out[:, i] = ((high << np.uint64(27)) + (lanes & np.uint64((1 << 27) - 1))) * (1.0 / (1 << 53))
    return out.reshape(-1)[:n]


class JavaRandom:
    """``java.util.Random``, of which whole 64-bit numbers are wanted."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> 16
        return x - (1 << 32) if x >> 31 else x

    def long(self) -> int:
        high = self._next()
        x = ((high << 32) + self._next()) & _LONG
        return x - (1 << 64) if x >> 63 else x


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """``k`` of the numbers below ``n``, in the order in which Spark's reservoir holds them."""
    held = list(range(min(k, n)))
    if k < n:
        for x, u in zip(range(k, n), doubles(seed, 0, n - k).tolist(), strict=True):
            at = int(u * (x + 1))
            if at < k:
                held[at] = x
    return held


def first_int(seed: int) -> int:
    """``nextInt`` of a new ``XORShiftRandom``."""
    x = int(_step(np.array([start(seed)], np.uint64))[0]) & _WORD
    return x - (1 << 32) if x >> 31 else x


class BernoulliSample:
    """Which elements of a partition ``rdd.sample(False, fraction, seed)`` takes, asked in order."""

    def __init__(self, fraction: float, seed: int, partition: int):
        seeds = JavaRandom(seed)
        for _ in range(partition + 1):
            self.seed = seeds.long()
        self.fraction, self.drawn, self.seen, self.next = fraction, 0, 0, np.zeros(0, np.int64)

    def take(self, n: int) -> np.ndarray:
        """Places among the next ``n`` elements of those taken."""
        start, self.seen = self.seen, self.seen + n
        if self.fraction >= 1.0:
            return np.arange(n)
        if self.fraction > 0.4:  # beyond this Spark draws a number for each element, else one for each gap
            return np.flatnonzero(doubles(self.seed, start, n) <= self.fraction)
        while not len(self.next) or self.next[-1] < self.seen:
            u = np.maximum(doubles(self.seed, self.drawn, 1024), 5e-11)
            self.drawn += len(u)
            gaps = (np.log(u) / np.log1p(-self.fraction)).astype(np.int64)
            last = self.next[-1] if len(self.next) else -1
            self.next = np.concatenate([self.next, last + np.cumsum(gaps + 1)])
        taken, self.next = self.next[self.next < self.seen], self.next[self.next >= self.seen]
        return taken - start
