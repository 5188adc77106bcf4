"""Look-up tables from gamma and splines, built on the driver: a table has 256 or 65,536 entries."""

from __future__ import annotations

import numpy as np

# Slope parameters near zero for two common gammas.
_TOE = {0.5: 224.0, 0.45: 287.806332841221}


def _toe(gamma: np.float32) -> np.float32:
    for known, value in _TOE.items():
        if abs(gamma - np.float32(known)) < np.float32(0.0001):
            return np.float32(value)
    # The fixed point of a -> ((a + 1) ** gamma - 1) / gamma ** 4.
    one, scale = np.float32(1), np.float32(1 / (np.float32(gamma * gamma) * np.float32(gamma * gamma)))
    a = np.float32(224)
    for _ in range(200):
        before, a = a, np.float32(scale * np.float32(np.power(a + one, gamma) - one))
        if abs(before - a) < np.float32(1e-6):
            break
    return a


def from_gamma(n: int, black: float, white: float, gamma: float, bits: int = 8) -> list[int]:
    """n entries: 0 below black, the most from white on, a power in between, with a finite slope at zero for gamma below 1."""
    f = np.float32
    most, g = f(2**bits - 1), f(gamma)
    low, high = int(f(black) * f(n)), int(f(white) * f(n))
    x = (np.arange(high - low, dtype=np.float32)) / f(high - low - 1) if high - low > 1 else np.zeros(max(0, high - low), np.float32)
    if gamma < 1:
        a = _toe(g)
        y = most * (np.power(a * x + f(1), g) - f(1)) / f(np.power(a + f(1), g) - f(1))
    else:
        y = most * np.power(x, g)
    y = np.clip(y, 0, most).astype(np.int64)
    return [0] * low + y.tolist() + [int(most)] * (n - high)


def spline(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(x, a, b, c, d) of each piece of the natural cubic spline through (0, 0), the points and (1, 1)."""
    p = np.array([(0.0, 0.0), *points, (1.0, 1.0)])
    dx, dy = np.diff(p[:, 0]), np.diff(p[:, 1])
    n = len(dx)
    step = np.where(np.abs(dx) < 0.001, 0.001, dx)
    b = np.zeros(n + 1)
    if n > 1:
        m = np.diag(2 * (dx[:-1] + dx[1:])) + np.diag(dx[1:-1], 1) + np.diag(dx[1:-1], -1)
        b[1:n] = np.linalg.lstsq(m, 3 * (dy[1:] / step[1:] - dy[:-1] / step[:-1]), rcond=None)[0]
    flat = np.abs(dx) < 1e-7
    safe = np.where(flat, 1, dx)
    a = np.where(flat, 0, (b[1:] - b[:-1]) / (3 * safe))
    c = np.where(flat, 0, dy / safe - dx * (b[1:] + 2 * b[:-1]) / 3)
    return [tuple(map(float, row)) for row in zip(p[:-1, 0], a, b[:-1], c, p[:-1, 1], strict=True)]


def from_spline(n: int, black: float, white: float, pieces: list[tuple[float, float, float, float, float]], bits: int = 8) -> list[int]:
    """n entries: 0 below black, the most from white on, the spline in between."""
    low, high, most = int(np.float32(black) * np.float32(n)), int(np.float32(white) * np.float32(n)), 2**bits - 1
    x = np.arange(high - low) / max(1, high - low - 1)
    k = np.clip(np.searchsorted([q[0] for q in pieces], x, "right") - 1, 0, len(pieces) - 1)
    x0, a, b, c, d = np.array(pieces)[k].T.reshape(5, -1)
    t = x - x0
    y = np.clip(most * (((a * t + b) * t + c) * t + d), 0, most).astype(np.int64)
    return [0] * low + y.tolist() + [most] * (n - high)
