"""Groups of things that hang together, by arrays."""

from __future__ import annotations

import numpy as np


def linked(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `count` things the first one that links a-b reach from it: minima pass along links and to
    the things that labels stand for, so rounds follow the logarithm of a group's length."""
    label = np.arange(count)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, before[side], low)
            np.minimum.at(label, side, low)
        label = label[label]
        if (label == before).all():
            return label
