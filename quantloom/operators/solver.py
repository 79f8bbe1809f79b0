"""Mean-variance optimisation of small dense problems (up to 50 assets), in NumPy.

min-variance and frontier points are convex quadratic programs over {sum w = 1, low <= w <= high}; they are
solved by exact moves along the pair of assets that violates optimality most. A wanted return enters by its
multiplier, found by bisection; the best Sharpe ratio lies on the frontier and is found along the multiplier.
"""

from __future__ import annotations

import numpy as np

from quantloom.functions.constants import FRONTIER_POINTS, MAX_WEIGHT, RISK_FREE, TRADING_DAYS
from quantloom.functions.errors import InfeasibleConstraints, OptimizationFailed


def limits(n: int, cap: float = MAX_WEIGHT, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the weights; raises if they cannot sum to 1."""
    if cap * n < 1 - 1e-9:
        raise InfeasibleConstraints(f"{n} assets of at most {cap} cannot sum to 1", assets=n, cap=cap)
    return np.full(n, -cap if short else 0.0), np.full(n, float(cap))


def project(w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Nearest point with low <= w <= high and sum 1: a common shift, found by bisection."""
    a, b = (low - w).min() - 1, (high - w).max() + 1
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(w + m, low, high).sum() < 1 else (a, m)
    return np.clip(w + (a + b) / 2, low, high)


def _quadratic(cov: np.ndarray, tilt: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray, steps: int = 20_000, tol: float = 1e-13) -> np.ndarray:
    """argmin of w'Cw / 2 - tilt'w over the box and the budget; raises OptimizationFailed if far from it after all steps."""
    w = w.copy()
    g = cov @ w - tilt
    scale = max(np.abs(cov).max(), np.abs(tilt).max(), 1e-300)
    for _ in range(steps):
        up, down = w < high - 1e-15, w > low + 1e-15
        if not up.any() or not down.any():
            break
        i, j = np.flatnonzero(up)[np.argmin(g[up])], np.flatnonzero(down)[np.argmax(g[down])]
        gain = g[j] - g[i]
        if gain <= tol * scale:
            break
        bend = cov[i, i] + cov[j, j] - 2 * cov[i, j]
        move = min(high[i] - w[i], w[j] - low[j], gain / bend if bend > 1e-300 else np.inf)
        w[i] += move
        w[j] -= move
        g += move * (cov[:, i] - cov[:, j])
    else:
        if gain > 1e-6 * scale:
            raise OptimizationFailed(f"no convergence in {steps} steps", gap=float(gain / scale))
    return w


def start(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return project(np.full(len(low), 1 / len(low)), low, high)


def max_return_weights(mu: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Best return (exact for this linear program): the budget above the lower bounds, cut along the cumulated room of
    the assets in descending order of their means."""
    order = np.argsort(-mu, kind="stable")
    room = (high - low)[order]
    ahead = np.cumsum(room) - room
    w = low.astype(float)
    w[order] += np.clip(1 - low.sum() - ahead, 0, room)
    return w


def min_variance(cov: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _quadratic(cov, np.zeros(len(cov)), low, high, start(low, high))


def for_return(mu: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: float) -> np.ndarray | None:
    """Least variance with a return of at least `wanted`; None if out of reach."""
    w = min_variance(cov, low, high)
    if mu @ w >= wanted - 1e-12:
        return w
    top = max_return_weights(mu, low, high)
    if mu @ top < wanted - 1e-12:
        return None
    a, b = 0.0, 1.0
    while mu @ (x := _quadratic(cov, b * mu, low, high, w)) < wanted and b < 1e9:
        a, b, w = b, b * 4, x
    best = x if mu @ x >= wanted else top
    for _ in range(60):
        m = (a + b) / 2
        x = _quadratic(cov, m * mu, low, high, best)
        if mu @ x >= wanted:
            b, best = m, x
        else:
            a = m
    return best


def sharpe(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, risk_free: float = RISK_FREE) -> float:
    vol = float(np.sqrt(max(w @ cov @ w, 0)))
    return float((mu @ w - risk_free) / vol) if vol > 0 else 0.0


def max_sharpe(mu: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray, risk_free: float = RISK_FREE) -> np.ndarray:
    """Best ratio of excess return to volatility on the frontier. If some portfolio has a positive excess return, the best
    of all is there, and the ratio has one peak along the multiplier; else the ratio rises with the return."""
    top = max_return_weights(mu, low, high)
    found = [min_variance(cov, low, high), top]
    grid = np.concatenate([[0], np.logspace(-4, 5, 60)])
    w, values = found[0], []
    for m in grid:
        w = _quadratic(cov, m * mu, low, high, w)
        values.append(sharpe(w, mu, cov, risk_free))
        found.append(w)
    k = int(np.argmax(values))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, y = b - ratio * (b - a), a + ratio * (b - a)
        wx, wy = (_quadratic(cov, m * mu, low, high, found[2 + k]) for m in (x, y))
        found += [wx, wy]
        a, b = (a, y) if sharpe(wx, mu, cov, risk_free) > sharpe(wy, mu, cov, risk_free) else (x, b)
    return max(found, key=lambda x: sharpe(x, mu, cov, risk_free))


def annualised(returns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (ddof 1) of daily returns (days x assets), a year of 252 days."""
    return returns.mean(0) * TRADING_DAYS, np.atleast_2d(np.cov(returns.T)) * TRADING_DAYS


def frontier_targets(mu: np.ndarray, cov: np.ndarray, low: np.ndarray, high: np.ndarray, points: int = FRONTIER_POINTS) -> np.ndarray:
    return np.linspace(mu @ min_variance(cov, low, high), mu @ max_return_weights(mu, low, high), points)
