"""What a fit adds to the mean loss, or holds the weights to, beyond a smooth term.

``ridge(v)`` is smooth and joins the objective; ``l1(v)`` and ``bounds(lo, hi)`` are not: fits
with these step along a path that an orthant or the bounds bend, and compare trials by the
whole objective.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Ridge:
    """``value/2 * ||w||^2``."""

    value: float


@dataclass(frozen=True)
class L1:
    """``sum_j value_j * |w_j|``; one value for all weights (the bias too) or one each."""

    weight: float | tuple[float, ...]

    def _v(self, w):
        v = np.broadcast_to(np.asarray(self.weight, dtype=float), w.shape)
        if (v < 0).any():
            raise ValueError("an L1 weight must not be negative")
        return v

    def value(self, w) -> float:
        return float(self._v(w) @ np.abs(w))

    def change(self, w, to) -> float:
        return float(self._v(w) @ (np.abs(to) - np.abs(w)))

    def start(self, w):
        return w

    def descent(self, w, g):
        """The gradient of steepest descent of the whole objective (0 where no direction goes down)."""
        v = self._v(w)
        at_zero = np.where(g + v < 0, g + v, np.where(g - v > 0, g - v, 0.0))
        return np.where(w != 0, g + v * np.sign(w), at_zero)

    def aligned(self, w, d, slope):
        """d without the components that do not go down."""
        return np.where(d * slope < 0, d, 0.0)

    def bent(self, w, to, slope):
        """The end of a step, held in the orthant that it starts into."""
        orthant = np.where(w != 0, np.sign(w), -np.sign(slope))
        return np.where(np.sign(to) == orthant, to, 0.0)


@dataclass(frozen=True)
class Bounds:
    """``lower <= w <= upper``, one value for all weights or one each; None: open."""

    lower: float | tuple[float, ...] | None = None
    upper: float | tuple[float, ...] | None = None

    def _ends(self, w):
        lo = np.broadcast_to(np.asarray(-np.inf if self.lower is None else self.lower, dtype=float), w.shape)
        hi = np.broadcast_to(np.asarray(np.inf if self.upper is None else self.upper, dtype=float), w.shape)
        if (lo > hi).any():
            raise ValueError("a lower bound is above its upper bound")
        return lo, hi

    def value(self, w) -> float:
        return 0.0

    def change(self, w, to) -> float:
        return 0.0

    def start(self, w):
        return np.clip(w, *self._ends(w))

    def descent(self, w, g):
        lo, hi = self._ends(w)
        return np.where((w <= lo) & (g > 0) | (w >= hi) & (g < 0), 0.0, g)

    def aligned(self, w, d, slope):
        """d without the components of weights that stay at a bound."""
        lo, hi = self._ends(w)
        return np.where((slope == 0) & ((w <= lo) | (w >= hi)), 0.0, d)

    def bent(self, w, to, slope):
        return np.clip(to, *self._ends(w))


def ridge(value: float) -> Ridge:
    return Ridge(float(value))


def l1(weight) -> L1:
    return L1(weight if isinstance(weight, (int, float)) else tuple(weight))


def bounds(lower=None, upper=None) -> Bounds:
    pick = lambda v: v if v is None or isinstance(v, (int, float)) else tuple(v)
    return Bounds(pick(lower), pick(upper))
