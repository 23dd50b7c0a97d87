"""Winnowing of one text over rolling hashes of its character grams, on arrays."""

from __future__ import annotations

import re

import numpy as np

_BLANKS = re.compile("[ \t-\r]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Runs of blanks as one space, none at the ends."""
    return _BLANKS.sub(" ", text).strip(" ")


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` characters; of all where there are fewer, none of none.

    A run is a number to a fixed base, modulo 2**64, whose bits are then mixed. The numbers of
    all runs come from those of half as long runs.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    k = min(k, len(codes))
    if not k:
        return codes
    value, width, power = codes, 1, _BASE
    with np.errstate(over="ignore"):
        for bit in bin(k)[3:]:
            value = value[: len(value) - width] * power + value[width:]
            power, width = power * power, 2 * width
            if bit == "1":
                value = value[: len(codes) - width] * _BASE + codes[width:]
                power, width = power * _BASE, width + 1
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are least in some window of ``window`` hashes, the rightmost among equals.

    Fewer hashes are one window. The place of the least of ``2 * width`` is one of those of the
    two halves, so the width doubles a pass; the last pass takes two that overlap.
    """
    window = min(window, len(hashes))
    if not window:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return best[np.flatnonzero(np.diff(best, prepend=-1))]


def fingerprint(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` of a text, by position in its normal form."""
    hashes = gram_hashes(normal(text), k)
    chosen = winnow(hashes, window)
    return hashes[chosen], chosen


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct hashes; 1 where both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0
