"""The curve 1 / (1 + a x^(2b)) that a layout's distances follow."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=64)
def find_ab(spread: float = 1.0, min_dist: float = 0.15) -> tuple[float, float]:
    """Least squares over 300 points of [0, 3 spread] against 1 up to ``min_dist`` and
    exp(-(x - min_dist) / spread) beyond, by damped Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 300)
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-3
    logx = np.log(np.maximum(x, 1e-300))

    def at(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power = np.where(x > 0, np.exp(2 * p[1] * logx), 0.0)
        f = 1 / (1 + p[0] * power)
        return f - y, np.stack([-power * f * f, -2 * p[0] * np.where(x > 0, logx, 0.0) * power * f * f], axis=1)

    r, jac = at(p)
    for _ in range(500):
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal)), -jac.T @ r)
        nxt = p + step
        r2, jac2 = at(nxt) if nxt[0] > 0 and nxt[1] > 0 else (r + 1, jac)
        if r2 @ r2 <= r @ r:
            p, r, jac, damp = nxt, r2, jac2, damp / 4
            if abs(step).max() < 1e-13:
                break
        else:
            damp *= 8
            if damp > 1e12:
                break
    return float(p[0]), float(p[1])
