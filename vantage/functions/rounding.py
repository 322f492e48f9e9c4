"""Rounding of arrays inside tasks."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's ``round`` makes of these doubles: half up, by the shortest decimal that stands for each. Entries that may lie half way,
    or are too large to be scaled, are rounded one by one as decimals."""
    scale = 10.0**digits
    size = np.abs(x)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = size * scale
        whole = np.floor(scaled)
        rest = scaled - whole
        out = np.copysign((whole + (rest >= 0.5)) / scale, x) + 0.0
        doubtful = ~(np.abs(rest - 0.5) > scaled * 1e-15) | ~(scaled < 2.0**50)
    for i in np.flatnonzero(doubtful):
        if np.isfinite(x[i]):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if size[i] < 1e18 else x[i]
        else:
            out[i] = x[i]
    return out
