"""Repeated box filters, which stand in for Gaussians."""

from __future__ import annotations

import math

import numpy as np

PASSES = 4


def radius(sigma: float, passes: int = PASSES) -> int:
    """Radius of the box of which `passes` have about the spread of a Gaussian."""
    return int(0.5 * math.sqrt(12.0 * sigma * sigma / passes + 1))


def kernel(r: int, passes: int = PASSES) -> list[float]:
    """Weights, from -r * passes to r * passes, of that many passes of a box of radius r."""
    box, out = np.ones(2 * r + 1), np.ones(1)
    for _ in range(passes):
        out = np.convolve(out, box)
    return (out / float(2 * r + 1) ** passes).tolist()


def low_pass(n: int, degrees: int) -> list[complex]:
    """What a unit pulse becomes when only the first `degrees` of its n Fourier coefficients stay."""
    return [sum(np.exp(2j * np.pi * k * m / n) for k in range(min(degrees, n))) / n for m in range(n)]
