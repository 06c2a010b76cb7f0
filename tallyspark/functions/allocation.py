"""Integer allocations by weight."""

from __future__ import annotations

import numpy as np


def largest_remainder(total: int, weights: np.ndarray) -> np.ndarray:
    """total dealt by weight in whole numbers: floors, then one more for the largest remainders, the higher index first among equals."""
    weights = np.maximum(np.asarray(weights, float), 0.0)
    if total <= 0 or not len(weights):
        return np.zeros(len(weights), np.int64)
    if weights.sum() <= 0:
        weights = np.ones(len(weights))
    raw = weights / weights.sum() * total
    out = np.floor(raw).astype(np.int64)
    order = np.lexsort((-np.arange(len(raw)), -(raw - out)))
    left = int(total - out.sum())
    out[order[:left]] += 1
    return out


def capped(total: int, weights: np.ndarray, caps: np.ndarray, relax: bool = False) -> tuple[np.ndarray, int]:
    """total dealt by weight with no share above its cap; and what didn't fit. With relax, caps rise evenly until all fits."""
    weights, caps = np.maximum(np.asarray(weights, float), 0.0), np.maximum(np.asarray(caps, np.int64), 0)
    out, left = np.zeros(len(weights), np.int64), int(total)
    while left > 0:
        room = caps - out
        open_ = (room > 0) & (weights > 0)
        if not open_.any():
            open_ = room > 0
            if not open_.any():
                break
        share = np.minimum(largest_remainder(left, np.where(open_, np.where(weights > 0, weights, 1e-9), 0.0)), room)
        if not share.sum():
            break
        out += share
        left -= int(share.sum())
    if relax and left:
        out += largest_remainder(left, np.ones(len(out)))
        left = 0
    return out, left


def banded_gaussian(m: int, center: float, spread: float, floor: float = 0.0) -> np.ndarray:
    """Weights that fall off around a centre on a ring of m partitions."""
    at = np.arange(m)
    away = np.minimum(np.abs(at - center), m - np.abs(at - center))
    return np.exp(-0.5 * (away / max(spread, 1e-6)) ** 2) + floor


def diluted(weights: np.ndarray, share: float) -> np.ndarray:
    """Weights mixed with an even share."""
    weights = weights / weights.sum()
    return (1 - share) * weights + share / len(weights)
