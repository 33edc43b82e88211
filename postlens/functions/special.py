"""Derivatives of the logarithm of the gamma function, for arrays of positive numbers."""

from __future__ import annotations

import numpy as np

_SHIFT = 8
# Coefficients of the asymptotic series, from the Bernoulli numbers.
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760, -1 / 12)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def _shifted(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``x`` raised by ``_SHIFT``, where the series holds, and the numbers passed on the way."""
    x = np.asarray(x, float)
    return x + _SHIFT, [x + i for i in range(_SHIFT)]


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    high = x + _SHIFT
    square = 1 / (high * high)
    series = _DIGAMMA[-1] * square
    for c in reversed(_DIGAMMA[:-1]):
        series += c
        series *= square
    # the sum of 1 / (x + i) for i from 0 to 7: i and 7 - i together, then two such pairs
    ends = x * (x + 7)
    passed = (x + 3.5) * (
        (4 * ends + 12) / (ends * (ends + 6)) + (4 * ends + 44) / ((ends + 10) * (ends + 12))
    )
    return np.log(high) - 0.5 / high + series - passed


def trigamma(x: np.ndarray) -> np.ndarray:
    high, passed = _shifted(x)
    square = 1 / (high * high)
    series = np.zeros_like(high)
    for c in reversed(_TRIGAMMA):
        series = (series + c) * square
    return 1 / high + 0.5 * square + series / high + sum(1 / (p * p) for p in passed)
