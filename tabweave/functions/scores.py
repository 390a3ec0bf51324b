"""Score polynomials: quantiles of gamma, beta and chi-squared laws.

Spark has no incomplete gamma or beta function.  For each law in a model the
driver integrates its density once (a few thousand numbers, whatever the size
of the data), reads the quantile curve off at Chebyshev points of z and of the
shape, and hands Spark a polynomial, which is plain arithmetic inside generated
code.  What the polynomial gives is a *score* that varies slowly:
``(ln x - ln k) * sqrt(k)`` for gamma(k) and ``logit x * sqrt(a + b)`` for beta.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from numpy.polynomial import chebyshev

from tabweave.functions.repair import PERCENTILE_FLOOR
from tabweave.functions.text import Sql, double

GRID = 20_000        # integration steps of a density
Z_NODES = 45         # Chebyshev points along z
SHAPE_NODES = 10     # Chebyshev points along a shape that varies
WIDE = 3.0           # shapes that vary by more than this ratio are taken in logs
TOLERANCE = 5e-7     # relative size of the Chebyshev terms that are dropped


def z_limit(floor: float = PERCENTILE_FLOOR) -> float:
    """The normal score at which percentiles are clipped."""
    return -NormalDist().inv_cdf(floor)


def _gamma_density(k: float, floor: float):
    """Grid over ln(x / k), density up to a factor, slope of its logarithm, scores.

    Written with expm1, so that nothing cancels however large k is.
    """
    share = math.log(floor * 1e-3)
    reach = z_limit(floor) + 1.7
    side = reach / (3.0 * math.sqrt(k))
    middle = 1.0 - 1.0 / (9.0 * k)
    low = (share + math.lgamma(k + 1.0)) / k - math.log(k)
    if middle - side > 0.2:
        low = max(low, 3.0 * math.log(middle - side))
    high = 3.0 * math.log(max(middle, 0.0) + side)
    t = np.linspace(low, high, GRID + 1)
    excess = np.where(np.abs(t) < 1e-4, t * t * (0.5 + t * (1 / 6 + t / 24)), np.expm1(t) - t)
    return t, np.exp(-k * excess), -k * np.expm1(t), t * math.sqrt(k)


def _beta_density(a: float, b: float, floor: float):
    """The same for beta(a, b), over logit x."""
    share = math.log(floor * 1e-3)
    ln_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    low = min((share + math.log(a) + ln_beta) / a, -1.0)
    high = max(-(share + math.log(b) + ln_beta) / b, 1.0)
    t = np.linspace(low, high, GRID + 1)
    mode = a * math.log(a / (a + b)) + b * math.log(b / (a + b))
    f = np.exp(-a * np.logaddexp(0.0, -t) - b * np.logaddexp(0.0, t) - mode)
    return t, f, a - (a + b) / (1.0 + np.exp(-t)), t * math.sqrt(a + b)


def curve(family: str, shape: tuple[float, ...], z: np.ndarray, floor: float) -> np.ndarray:
    """Scores at the given z for one law."""
    density = _beta_density if family == "beta" else _gamma_density
    t, f, slope, score = density(*shape, floor)
    h = t[1] - t[0]
    # trapezoids with the first Euler-Maclaurin correction, from either end;
    # the mass outside the grid is f / |slope|
    steps = h * (f[1:] + f[:-1]) / 2.0 - h * h / 12.0 * np.diff(f * slope)
    below = f[0] / slope[0] + np.concatenate([[0.0], np.cumsum(steps)])
    above = -f[-1] / slope[-1] + np.concatenate([np.cumsum(steps[::-1])[::-1], [0.0]])
    total = below[-1] - f[-1] / slope[-1]
    p = np.array([0.5 * math.erfc(abs(x) / math.sqrt(2.0)) for x in z])
    from_low = np.interp(np.log(p), np.log(below / total), score)
    from_high = np.interp(np.log(p), np.log(above[::-1] / total), score[::-1])
    return np.where(z < 0.0, from_low, from_high)


@dataclass(frozen=True)
class Axis:
    """A shape parameter, normalised to [-1, 1]; in logs if it varies widely."""

    low: float
    high: float

    @property
    def fixed(self) -> bool:
        return self.high <= self.low

    @property
    def logs(self) -> bool:
        return self.high > WIDE * self.low

    def nodes(self) -> np.ndarray:
        if self.fixed:
            return np.array([self.low])
        at = chebyshev.chebpts1(SHAPE_NODES)
        low, high = (math.log(self.low), math.log(self.high)) if self.logs else (self.low, self.high)
        points = (low + high) / 2.0 + (high - low) / 2.0 * at
        return np.exp(points) if self.logs else points

    def normalise(self, shape: Sql) -> Sql:
        low, high = self.low, self.high
        if self.logs:
            low, high, shape = math.log(low), math.log(high), f"coalesce(ln({shape}), 0.0D)"
        return f"({shape} - {double((low + high) / 2.0)}) * {double(2.0 / (high - low))}"


@dataclass(frozen=True)
class ScorePolynomial:
    """score(z, shape...) as a polynomial; powers of z come first."""

    coefficients: np.ndarray
    limit: float
    axes: tuple[Axis, ...]

    @classmethod
    def of(cls, family: str, ranges: list[tuple[float, float]], floor: float = PERCENTILE_FLOOR):
        """Fit for shapes inside the given (low, high) ranges."""
        limit = z_limit(floor)
        z = limit * chebyshev.chebpts1(Z_NODES)
        axes = tuple(Axis(*r) for r in ranges)
        grid = np.meshgrid(*(axis.nodes() for axis in axes), indexing="ij")
        values = np.empty((Z_NODES, *grid[0].shape))
        for at in np.ndindex(grid[0].shape):
            shape = tuple(float(g[at]) for g in grid)
            if family == "beta" and len(shape) == 1:
                shape = shape * 2
            values[(slice(None), *at)] = curve(family, shape, z, floor)
        # a score of gamma(k) or beta(k, .) moves the value by about its 1/sqrt(k)th
        scale = math.sqrt(max(1.0, axes[0].low))
        return cls(_to_powers(values, TOLERANCE * scale), limit, axes)

    def variables(self, z: Sql, shapes: list[Sql]) -> list[Sql]:
        """z and the shapes that vary, normalised; to be kept as columns."""
        return [f"{z} * {double(1.0 / self.limit)}"] + [
            axis.normalise(shape) for shape, axis in zip(shapes, self.axes) if not axis.fixed
        ]

    def score(self, variables: list[Sql]) -> Sql:
        """The polynomial over the columns made from :meth:`variables`."""
        varying = iter(variables[1:])
        named = [variables[0]] + ["0.0D" if axis.fixed else next(varying) for axis in self.axes]
        return _nested(self.coefficients, named)


def _to_powers(values: np.ndarray, tolerance: float) -> np.ndarray:
    """Chebyshev interpolation along every axis, small terms dropped, as powers."""
    c = values
    for axis, n in enumerate(values.shape):
        points = chebyshev.chebpts1(n)
        inverse = np.linalg.inv(chebyshev.chebvander(points, n - 1))
        c = np.moveaxis(np.tensordot(inverse, c, axes=(1, axis)), 0, axis)
    c = np.where(np.abs(c) < tolerance, 0.0, c)
    for axis, n in enumerate(values.shape):
        powers = np.zeros((n, n))
        for k in range(n):
            one = np.zeros(k + 1)
            one[k] = 1.0
            powers[: k + 1, k] = chebyshev.cheb2poly(one)
        c = np.moveaxis(np.tensordot(powers, c, axes=(1, axis)), 0, axis)
    return c


def _nested(c: np.ndarray, variables: list[Sql]) -> Sql:
    """Horner scheme, the last axis outermost."""
    if c.ndim == 1:
        return _horner([double(x) if x != 0.0 else None for x in c], variables[0])
    parts = []
    for i in range(c.shape[-1]):
        part = c[..., i]
        parts.append(_nested(part, variables[:-1]) if np.any(part != 0.0) else None)
    return _horner(parts, variables[-1])


def _horner(terms: list[Sql | None], x: Sql) -> Sql:
    """Sum of term i times x**i, where None is a missing term."""
    present = [i for i, term in enumerate(terms) if term is not None]
    if not present:
        return "0.0D"
    # a symmetric law has odd powers only: work in x * x
    if len(present) > 1 and all(i % 2 == present[0] % 2 for i in present):
        inner = _horner(terms[present[0] % 2 :: 2], f"({x} * {x})")
        return f"({inner} * {x})" if present[0] % 2 else inner
    terms = terms[: present[-1] + 1]
    total = terms[-1]
    for term in terms[-2::-1]:
        total = f"{total} * {x}" if term is None else f"({total} * {x} + {term})"
    return f"({total})"
