"""Small numpy helpers that several operators of this folder use inside their tasks."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal chances for every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its number, repeated, and all integers from begin up to end."""
    n = end - begin
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.cumprod(out, dtype="u8")


class Running:
    """Hashes of any run of values, as differences of one running sum."""

    def __init__(self, values: np.ndarray):
        self.total = np.concatenate((np.zeros(1, "u8"), np.cumsum(mix(values.astype("u8")) * powers(INVERSE, len(values)), dtype="u8")))
        self.power = powers(BASE, len(values) + 1)

    def of(self, begin: np.ndarray, n: int) -> np.ndarray:
        return (self.total[begin + n] - self.total[begin]) * self.power[begin]


def common_run(a: Running, i: np.ndarray, b: Running, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many values from i[k] of a and from j[k] of b on are equal, most[k] at most."""
    n = np.zeros(len(i), "i8")
    for bit in reversed(range(int(most.max(initial=0)).bit_length())):
        size = 1 << bit
        own = np.flatnonzero(n + size <= most)
        own = own[a.of(i[own] + n[own], size) == b.of(j[own] + n[own], size)]
        n[own] += size
    return n
