"""Full-batch quasi-Newton descent: BFGS and L-BFGS with a strong Wolfe line search.

The objective is a function of the flat weights that answers (value,
gradient); over a table every answer is one distributed job, so what counts is
how few are asked.  The search direction comes from the last ``memory``
curvature pairs (two-loop recursion) or, for BFGS, from the inverse Hessian
estimate built from all of them - weight-sized or weights x weights numbers on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

ARMIJO, CURVATURE = 1e-4, 0.9
MAX_BFGS = 4_000  # weights: BFGS holds their square in doubles (128 MB); larger networks take lbfgs


@dataclass
class Step:
    """The state after an iteration; ``converged`` if it is the last one because nothing is left to gain."""

    weights: np.ndarray
    value: float
    gradient: np.ndarray
    evaluations: int
    converged: bool = False


class Curvature:
    """Directions from past (weight change, gradient change) pairs."""

    def __init__(self, size: int, memory: int | None):
        if memory is None and size > MAX_BFGS:
            raise ValueError(f"bfgs takes at most {MAX_BFGS} weights, not {size}; use lbfgs")
        self.pairs: deque = deque(maxlen=memory or 1)
        self.inverse = np.eye(size) if memory is None else None

    def direction(self, g: np.ndarray) -> np.ndarray:
        if self.inverse is not None:
            return -self.inverse @ g
        q, coefficients = g.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            coefficients.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(self.pairs, reversed(coefficients), strict=True):
            q += s * (a - rho * (y @ q))
        return -q

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        """A pair without positive curvature is left out: the estimate stays positive definite."""
        sy = float(s @ y)
        if sy <= 1e-10 * float(np.sqrt((s @ s) * (y @ y))):
            return
        if self.inverse is None:
            self.pairs.append((s, y, 1 / sy))
            return
        if not self.pairs:
            self.inverse *= sy / (y @ y)
        self.pairs.append((s, y, 1 / sy))
        Hy = self.inverse @ y
        self.inverse += np.outer(s, s) * ((sy + y @ Hy) / sy**2) - (np.outer(Hy, s) + np.outer(s, Hy)) / sy

    def reset(self) -> None:
        self.pairs.clear()
        if self.inverse is not None:
            self.inverse = np.eye(len(self.inverse))


def cubic_minimum(a: float, fa: float, da: float, b: float, fb: float, db: float) -> float:
    """Where the cubic through two values and slopes is least; the middle if that lies too near an end."""
    low, high = min(a, b), max(a, b)
    middle = (a + b) / 2
    d1 = da + db - 3 * (fa - fb) / (a - b)
    square = d1 * d1 - da * db
    if not np.isfinite(square) or square < 0:
        return middle
    d2 = np.copysign(np.sqrt(square), b - a)
    bottom = db - da + 2 * d2
    if bottom == 0:
        return middle
    at = b - (b - a) * (db + d2 - d1) / bottom
    edge = 0.1 * (high - low)
    return at if low + edge <= at <= high - edge else middle


def wolfe_step(along: Callable[[float], tuple[float, float]], f0: float, d0: float, first: float, probes: int = 25) -> float | None:
    """A step length that meets the strong Wolfe conditions: widen until a bracket is found, then narrow it.

    ``along(t)`` answers value and slope; a value that is not finite counts as
    too far.  If the probes run out, the best length that still lowers the value enough, or None.
    """
    before, f_before, d_before = 0.0, f0, d0
    t, best = first, None
    noise = 8 * np.finfo(float).eps * max(1.0, abs(f0))  # near the minimum values differ by rounding only; slopes still tell
    bracket = None
    for k in range(probes):
        f, d = along(t)
        if np.isfinite(f) and f <= f0 + ARMIJO * t * d0 + noise and (best is None or f < best[1]):
            best = (t, f)
        if bracket is None:
            if not np.isfinite(f) or f > f0 + ARMIJO * t * d0 + noise or (k and f >= f_before + noise):
                bracket = (before, f_before, d_before, t, f, d)
            elif abs(d) <= -CURVATURE * d0:
                return t
            elif d >= 0:
                bracket = (t, f, d, before, f_before, d_before)
            else:
                before, f_before, d_before, t = t, f, d, 2 * t
                continue
        else:
            low, f_low, d_low, high, f_high, d_high = bracket
            if not np.isfinite(f) or f > f0 + ARMIJO * t * d0 + noise or f >= f_low + noise:
                bracket = (low, f_low, d_low, t, f, d)
            else:
                if abs(d) <= -CURVATURE * d0:
                    return t
                if d * (high - low) >= 0:
                    high, f_high, d_high = low, f_low, d_low
                bracket = (t, f, d, high, f_high, d_high)
        low, f_low, d_low, high, f_high, d_high = bracket
        if abs(high - low) * max(1.0, abs(d0)) < 1e-16:
            break
        t = cubic_minimum(low, f_low, d_low, high, f_high, d_high) if np.isfinite(f_high) else (low + high) / 2
    return None if best is None else best[0]


def descend(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, iterations: int,
            memory: int | None = 10, g_tol: float = 1e-8) -> Iterator[Step]:
    """One :class:`Step` per iteration; ``memory`` pairs for L-BFGS, None for BFGS.

    Ends after ``iterations``, at a gradient whose largest entry is ``g_tol``
    or less, or when not even the steepest direction lowers the value.
    """
    w = np.asarray(start, dtype=float).copy()
    f, g = objective(w)
    asked = 1
    if not np.isfinite(f):
        raise ArithmeticError(f"the objective is {f} at the start")
    known = Curvature(len(w), memory)
    for it in range(iterations):
        if np.abs(g).max(initial=0.0) <= g_tol:
            yield Step(w, f, g, asked, True)
            return
        found: dict[float, tuple[float, np.ndarray]] = {}
        for steepest in (False, True):
            p = -g if steepest else known.direction(g)
            slope = float(p @ g)
            if slope >= 0:
                known.reset()
                continue

            def along(t: float, p=p) -> tuple[float, float]:
                found[t] = objective(w + t * p)
                return found[t][0], float(p @ found[t][1])

            fresh = steepest or not known.pairs
            t = wolfe_step(along, f, slope, min(1.0, 1 / np.abs(g).sum()) if fresh else 1.0)
            asked += len(found)
            if t is not None:
                break
            known.reset()
            found.clear()
        else:
            yield Step(w, f, g, asked, True)
            return
        f_new, g_new = found[t]
        known.learn(t * p, g_new - g)
        w, f, g = w + t * p, f_new, g_new
        yield Step(w, f, g, asked, it + 1 < iterations and np.abs(g).max(initial=0.0) <= g_tol)
        if np.abs(g).max(initial=0.0) <= g_tol:
            return
