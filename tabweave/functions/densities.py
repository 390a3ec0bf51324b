"""Quantiles of a smooth density by numeric inversion, as a polynomial in z.

The driver integrates the density once, whatever the size of the data, inverts it at
Chebyshev points of z and hands Spark a polynomial, like those of
``tabweave.functions.scores``; its error is measured between the points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from numpy.polynomial import chebyshev

from tabweave.functions.repair import PERCENTILE_FLOOR, clip
from tabweave.functions.scores import _horner, _to_powers, z_limit
from tabweave.functions.text import Sql, double

CELLS = 4_000        # of the integration, with five points each
DROP = 45.0          # logarithm of the part of the peak at which the tails are cut
DROP_UNIT = 33.0     # the same in (0, 1), where doubles end near 1
MOST_NODES = 70      # Chebyshev points along z, at most
CHECKS = 2_001       # values of z at which the error is measured

LogDensity = Callable[[np.ndarray], np.ndarray]

# Where a value lies -> (value of t, logarithm of its slope, SQL of the value).
SUPPORTS = {
    "real": (lambda t: t, lambda t: 0.0 * t, "{}"),
    "positive": (np.exp, lambda t: t, "exp({})"),
    "unit": (lambda t: 1.0 / (1.0 + np.exp(-t)), lambda t: -np.logaddexp(0.0, t) - np.logaddexp(0.0, -t),
             "(1.0D / (1.0D + exp(-({}))))"),
}


@dataclass(frozen=True)
class Inversion:
    """t as a polynomial in z within the limit; the value is t, exp(t) or 1 / (1 + exp(-t)).

    ``error`` is the largest difference of t found at CHECKS values of z: absolute for a
    real support, relative to the value for a positive one.
    """

    coefficients: np.ndarray
    limit: float
    support: str
    error: float

    def value(self, z: Sql) -> Sql:
        """The value of a standard normal, given as a column; clipped to the limit."""
        position = f"({clip(z, -self.limit, self.limit)} * {double(1.0 / self.limit)})"
        terms = [double(x) if x != 0.0 else None for x in self.coefficients]
        return SUPPORTS[self.support][2].format(_horner(terms, position))


class _Mass:
    """Masses below and above any t, by Gauss-Legendre sums over cells."""

    def __init__(self, f: LogDensity, low: float, high: float, cells: int):
        self.f, self.edges = f, np.linspace(low, high, cells + 1)
        self.at, self.weights = np.polynomial.legendre.leggauss(5)
        steps = self.between(self.edges[:-1], self.edges[1:])
        self.below = np.concatenate([[0.0], np.cumsum(steps)])
        self.above = np.concatenate([np.cumsum(steps[::-1])[::-1], [0.0]])
        self.total = self.below[-1]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        half = (b - a) / 2.0
        points = (a + half)[:, None] + half[:, None] * self.at
        return half * (np.exp(self.f(points)) @ self.weights)

    def invert(self, p: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """t with the given share of the mass below it, or above it where ``upper``."""
        mass = np.maximum(np.where(upper, 1.0 - p, p), 1e-300) * self.total
        cell = np.clip(np.searchsorted(self.below, mass) - 1, 0, len(self.edges) - 2)
        own = len(self.edges) - 1 - np.searchsorted(self.above[::-1], p * self.total)
        cell = np.where(upper, np.clip(own, 0, len(self.edges) - 2), cell)
        low, high = self.edges[cell], self.edges[cell + 1]
        t = (low + high) / 2.0
        for _ in range(60):  # Newton steps, held inside the cell by halving
            part = self.between(low * 0 + self.edges[cell], t)
            rest = self.between(t, self.edges[cell + 1])
            over = np.where(upper, p * self.total - self.above[cell + 1] - rest,
                            self.below[cell] + part - p * self.total)
            high, low = np.where(over > 0, t, high), np.where(over > 0, low, t)
            step = t - over / np.exp(self.f(t))
            t = np.where((step > low) & (step < high), step, (low + high) / 2.0)
        return t


def invert(
    log_density: LogDensity, support: str = "real", floor: float = PERCENTILE_FLOOR, tolerance: float = 1e-7
) -> Inversion:
    """The quantile curve of a density given by its logarithm, up to a constant.

    ``log_density`` takes a numpy array of values of the support: all reals, positive
    numbers, or (0, 1).  Percentiles are clipped to [floor, 1 - floor].  Raises if the density
    is not finite somewhere, if its tails are too heavy to be cut, or if no polynomial
    reaches the tolerance, as with a density that has a kink, a gap or several far modes.
    """
    if support not in SUPPORTS:
        raise ValueError(f"support must be one of {sorted(SUPPORTS)}")
    of, slope, _ = SUPPORTS[support]

    def plain(t: np.ndarray) -> np.ndarray:
        return log_density(of(t)) + slope(t)

    reach = {"real": 11.0, "positive": 300.0, "unit": 36.0}[support]
    wide = np.linspace(-reach, reach, 40_001)
    wide = np.sinh(wide) if support == "real" else wide
    with np.errstate(all="ignore"):
        seen = plain(wide)
    cut = DROP_UNIT if support == "unit" else DROP
    inside = np.flatnonzero(seen > np.where(np.isfinite(seen), seen, -np.inf).max() - cut)
    peak = seen[inside].max() if len(inside) else np.nan
    if not np.isfinite(peak):
        raise ValueError("the density is not finite")
    if inside[0] == 0 or inside[-1] == len(wide) - 1:
        raise ValueError("the density's tails are too heavy for its support")
    low, high = wide[inside[0] - 1], wide[inside[-1] + 1]
    mass = _Mass(lambda t: plain(t) - peak, low, high, CELLS)
    finer = _Mass(lambda t: plain(t) - peak, low, high, 2 * CELLS)
    if not abs(mass.total / finer.total - 1.0) < 1e-10:
        raise ValueError("the density is not smooth enough to integrate")

    def curve(z: np.ndarray) -> np.ndarray:
        tail = np.array([NormalDist().cdf(-abs(x)) for x in z])
        return finer.invert(tail, z > 0)

    limit = z_limit(floor)
    checks = np.linspace(-1.0, 1.0, CHECKS)
    true, best = curve(limit * checks), None
    for nodes in range(15, MOST_NODES + 1, 5):
        values = curve(limit * chebyshev.chebpts1(nodes))
        powers = _to_powers(values, 1e-14 * max(1.0, float(np.abs(values).max())))
        error = float(np.abs(np.polynomial.polynomial.polyval(checks, powers) - true).max())
        if best is None or error < best.error:
            best = Inversion(powers, limit, support, error)
        if error < tolerance * 1e-3:
            break
    if not best.error < tolerance:
        raise ValueError(f"the error of the quantile's polynomial is {best.error:.2g}, above {tolerance:.2g}")
    return best
