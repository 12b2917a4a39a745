"""Numerical derivatives of functions of a vector, on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_STEP = np.finfo(float).eps ** 0.2


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    """Central differences of fourth order."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    for k in range(x.size):
        h = _STEP * max(1.0, abs(x.flat[k]))

        def at(t: float, k: int = k, h: float = h) -> float:
            y = x.copy()
            y.flat[k] += t * h
            return f(y)

        out.flat[k] = (at(-2) - 8 * at(-1) + 8 * at(1) - at(2)) / (12 * h)
    return out


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    """Central differences of second order; mixed ones from four points."""
    x = np.asarray(x, float).ravel()
    n = x.size
    h = np.finfo(float).eps ** 0.25 * np.maximum(1.0, np.abs(x))
    out, centre = np.empty((n, n)), f(x)

    def at(*moves: tuple[int, int]) -> float:
        y = x.copy()
        for k, s in moves:
            y[k] += s * h[k]
        return f(y)

    for i in range(n):
        out[i, i] = (at((i, 1)) - 2 * centre + at((i, -1))) / h[i] ** 2
        for j in range(i):
            out[i, j] = out[j, i] = (at((i, 1), (j, 1)) - at((i, 1), (j, -1)) - at((i, -1), (j, 1)) + at((i, -1), (j, -1))) / (4 * h[i] * h[j])
    return out
