"""Rows of characters as arrays: hashes of stretches, sorted look-ups, places of many stretches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per stretch of a row of code points or bytes: its characters, plus 1, as digits to the base ``_P``, modulo 2^64.

    Sums up to each place, weighted by powers of the base, give every stretch by one difference; as the base is odd it has
    an inverse, which moves the stretch back to the first power.
    """
    n = 1 << max(16, int(len(codes) + 1).bit_length())
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((codes.astype(_U) + _U(1)) * powers(n, _P)[: len(codes)])))
    return (sums[ends] - sums[starts]) * powers(n, _P_INVERSE)[starts]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)


def find_sorted(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in ascending keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i] - 1, for all i in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
