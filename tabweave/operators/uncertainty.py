"""Indeterminacy: every fitted parameter becomes an interval around its value.

At level IN a parameter p turns into a draw from [p(1-IN), p(1+IN)], one draw
per column and block of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from tabweave.functions.randomness import Rng, between
from tabweave.functions.text import Sql, double, sql

BLOCK_ROWS = 10_000   # rows by id that share one draw, unless the caller says otherwise
POSITIVE_FLOOR = 1e-6  # fixed value: lower limit of scale-like parameters
FLOORED = ("scale", "shape", "c", "s", "a", "b")

FactorOf = Callable[[str], Sql]


def factor(rng: Rng, block: Sql, in_level: float | Sql, tag: str) -> Sql:
    """A draw from [1 - IN, 1 + IN] for one block."""
    level = sql(in_level)
    return between(rng.uniform(block, tag), f"(1.0D - {level})", f"(1.0D + {level})")


def widen(params: dict[str, Sql], factor_of: FactorOf) -> dict[str, Sql]:
    """Multiply each parameter by its factor and keep it in its valid range."""
    out = {}
    for name, value in params.items():
        moved = f"{value} * {factor_of(name)}"
        if name == "df":
            moved = f"greatest(cast({moved} as bigint), 1L)"
        elif name in FLOORED:
            moved = f"greatest({moved}, {double(POSITIVE_FLOOR)})"
        out[name] = moved
    return out


def shared(rng: Rng, block: Sql, in_level: float | Sql, col_name: str) -> FactorOf:
    """One factor for all parameters of a column."""
    return lambda name: factor(rng, block, in_level, f"{col_name}/g")


def independent(rng: Rng, block: Sql, in_level: float | Sql, col_name: str) -> FactorOf:
    """One factor per parameter."""
    return lambda name: factor(rng, block, in_level, f"{col_name}/g/{name}")


MODES = {"shared": shared, "independent": independent}


def fallback_normal(
    mean_nonzero: float | Sql, std_nonzero: float | Sql, factor_of: FactorOf
) -> dict[str, Sql]:
    """Parameters for a column without a law: a normal with both moved apart."""
    std = f"greatest({sql(std_nonzero)}, {double(POSITIVE_FLOOR)})"
    return {
        "loc": f"{sql(mean_nonzero)} * {factor_of('loc')}",
        "scale": f"{std} * {factor_of('scale')}",
    }
