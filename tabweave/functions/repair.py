"""Masks, clips and repairs applied to single values."""

from __future__ import annotations

from tabweave.functions.text import Sql, double, sql

PERCENTILE_FLOOR = 1e-6   # fixed value: clip of copula percentiles
ZERO_RATIO_MIN = 0.01     # fixed value: no zero injection at or below this share
RANGE_LOW = 0.9           # fixed value: lower range clip as a share of the minimum
RANGE_HIGH = 1.1          # fixed value: upper range clip as a share of the maximum


def nan_to_null(x: Sql) -> Sql:
    """Treat NaN like a missing value, as aggregates should."""
    return f"nullif({x}, double('NaN'))"


def positive(x: Sql) -> Sql:
    """x where x > 0, else null.  NaN counts as not positive."""
    return f"if({x} > 0 and not isnan({x}), {x}, null)"


def clip(x: Sql, low: float | Sql, high: float | Sql) -> Sql:
    """Clip where the upper bound wins when the bounds cross."""
    return f"least(greatest({x}, {sql(low)}), {sql(high)})"


def clip_percentile(u: Sql, floor: float = PERCENTILE_FLOOR) -> Sql:
    """Keep a percentile inside [floor, 1 - floor]."""
    return clip(u, floor, 1.0 - floor)


def clip_range(x: Sql, low: float | Sql | None, high: float | Sql | None) -> Sql:
    """Clip to [0.9 * min, 1.1 * max]; a missing bound leaves that side open."""
    if low is not None:
        x = f"greatest({x}, {sql(low)} * {double(RANGE_LOW)})"
    if high is not None:
        x = f"least({x}, {sql(high)} * {double(RANGE_HIGH)})"
    return x


def repair(x: Sql, if_nan: float | Sql, if_high: float | Sql | None = None,
           if_low: float | Sql | None = None) -> Sql:
    """Replace null/NaN, +Infinity and -Infinity; run this before the range clip."""
    cases = [f"when {x} is null or isnan({x}) then {sql(if_nan)}"]
    if if_high is not None:
        cases.append(f"when {x} = double('Infinity') then {sql(if_high)}")
    if if_low is not None:
        cases.append(f"when {x} = double('-Infinity') then {sql(if_low)}")
    return f"case {' '.join(cases)} else {x} end"


def inject_zero(x: Sql, u: Sql, zero_ratio: float | Sql) -> Sql:
    """Set x to 0 with probability zero_ratio, if that share exceeds 1 %."""
    share = sql(zero_ratio)
    return f"if({share} > {double(ZERO_RATIO_MIN)} and {u} < {share}, 0.0D, {x})"
