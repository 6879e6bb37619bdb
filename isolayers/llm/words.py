"""Vectorised word spans and substring hashes of UTF-8 texts, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash; odd numbers have an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; the tables grow with the longest text seen."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def normal(body: bytes) -> bytes:
    """Words ([^\\x20\\x09-\\x0D]+) joined by one space; bytes.split() splits at just these characters."""
    return b" ".join(body.split())


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a normal() text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(text)]))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of SplitMix64)."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """64-bit hashes of any substring of one buffer, from running sums."""

    def __init__(self, text: bytes):
        up, self.down = powers(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * up[: len(text)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = f(out[:-step], out[step:])
        have += step
    return out
