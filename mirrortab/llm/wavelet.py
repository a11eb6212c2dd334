"""Wavelet matrix over an array of whole numbers, asked many questions at a time."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bits of the values from the highest down; every level lists zeros before ones, in order."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = int(values.max()).bit_length() if len(values) else 0
        self.zeros: list[np.ndarray] = []  # zeros among the first i entries of a level
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[~ones], values[ones]))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many entries in places ``low`` to ``high`` (without) are less than ``x``, for each question."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        beyond = x >> self.bits > 0
        count[beyond] = (high - low)[beyond]
        for level, zeros in enumerate(self.zeros):
            a, b = zeros[low], zeros[high]
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(one & ~beyond, b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest entry, from 0, in places ``low`` to ``high`` (without)."""
        low, high, n, value = low.copy(), high.copy(), n.copy(), np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            one = n >= b - a
            n -= np.where(one, b - a, 0)
            value = value * 2 + one
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return value
