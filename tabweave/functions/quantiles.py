"""Quantile functions of the eight families.

Every function maps one draw (a standard normal ``z``, a percentile ``u`` or a
tabulated ``score``) and the parameters to a value.  The three families without
a closed form read a score from the polynomials of ``tabweave.functions.scores``.
"""

from __future__ import annotations

from dataclasses import dataclass

from tabweave.functions.text import Sql, double

Params = dict[str, Sql]


@dataclass(frozen=True)
class Draw:
    """What a quantile function may use; unused parts may be None."""

    z: Sql | None = None
    u: Sql | None = None
    score: Sql | None = None


def log1m(u: Sql) -> Sql:
    """ln(1 - u) for u in [0, 1), typed as never null."""
    return f"coalesce(ln(1.0D - {u}), 0.0D)"


def over(top: Sql, positive: Sql) -> Sql:
    """A quotient whose denominator is positive, typed as never null."""
    return f"coalesce({top} / {positive}, 0.0D)"


def normal(draw: Draw, p: Params) -> Sql:
    return f"{p['loc']} + {p['scale']} * {draw.z}"


def lognormal(draw: Draw, p: Params) -> Sql:
    return f"{p['scale']} * exp({p['s']} * {draw.z})"


def exponential(draw: Draw, p: Params) -> Sql:
    return f"-{p['scale']} * {log1m(draw.u)}"


def weibull(draw: Draw, p: Params) -> Sql:
    return f"{p['scale']} * power(-{log1m(draw.u)}, try_divide(1.0D, {p['c']}))"


def uniform(draw: Draw, p: Params) -> Sql:
    return f"{p['loc']} + {p['scale']} * {draw.u}"


def beta_2_2(u: Sql) -> Sql:
    """Quantile of beta(2, 2): the root of 3x^2 - 2x^3 = u."""
    return f"(0.5D - sin(asin(1.0D - 2.0D * {u}) * {double(1.0 / 3.0)}))"


def beta(draw: Draw, p: Params) -> Sql:
    if draw.score is None:
        return f"{p['loc']} + {p['scale']} * {beta_2_2(draw.u)}"
    logit = over(draw.score, f"sqrt({p['a']} + {p['b']})")
    return f"{p['loc']} + " + over(p["scale"], f"(1.0D + exp(-{logit}))")


def _unit_gamma(score: Sql, shape: Sql) -> Sql:
    return f"{shape} * exp({over(score, f'sqrt({shape})')})"


def gamma(draw: Draw, p: Params) -> Sql:
    return f"{p['scale']} * {_unit_gamma(draw.score, p['shape'])}"


def chi2(draw: Draw, p: Params) -> Sql:
    return f"2.0D * {_unit_gamma(draw.score, f'({p['df']} * 0.5D)')}"
