"""Log-gamma, and the regularised incomplete gamma and beta functions, as column expressions.

Series and continued fractions run from the last term back to the first, as a fold over a
sequence inside the JVM.  A row's number of terms follows its own arguments, so there is no
shape that they are too few for; it grows with the square root of the shape.  Pass plain
columns: arguments are used many times.

Spark interprets such a fold term by term, at some 40 microseconds a value.  Exact scores
(:func:`polish`) take the same terms, in the same order, batch by batch over arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.normal import normal_cdf_array
from tabweave.functions.text import Sql, double, ident

# The first coefficients of Stirling's series, from the lowest power of 1/k up.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
SHIFT = 10  # smaller arguments are moved up by so much before the series is used


def _fold(count: Sql, start: Sql, step: Sql) -> Sql:
    """``step`` over j = count, ..., 1, from the accumulator ``s``."""
    return f"aggregate(sequence(cast({count} as int), 1, -1), {start}, (s, j) -> {step})"


def _correction(k: Sql) -> Sql:
    """ln k! less the leading terms of Stirling's formula, for k of at least SHIFT."""
    total = double(STIRLING[-1])
    for c in STIRLING[-2::-1]:
        total = f"({total} / ({k} * {k}) + {double(c)})"
    return f"({total} / {k})"


def log_gamma(k: Sql) -> Sql:
    """ln of the gamma function for k > 0, to about 1e-15 of its size."""
    up = f"({k} + {double(SHIFT)})"
    leading = f"({{0}} - 0.5D) * ln({{0}}) - {{0}} + {double(0.5 * math.log(2 * math.pi))}"
    product = " * ".join(f"({k} + {double(i)})" for i in range(SHIFT))
    return (f"if({k} >= {double(SHIFT)}, {leading.format(k)} + {_correction(k)}, "
            f"{leading.format(up)} + {_correction(up)} - ln({product}))")


def gamma_weight(k: Sql, t: Sql) -> Sql:
    """x^k exp(-x) / Gamma(k) for x = k exp(t): the density of ln x.  Nothing cancels for large k."""
    large = (f"sqrt({k} * {double(1 / (2 * math.pi))}) * "
             f"exp(-{k} * (expm1({t}) - {t}) - {_correction(k)})")
    small = f"exp({k} * ({t} + ln({k})) - {k} * exp({t}) - ({log_gamma(k)}))"
    return f"if({k} >= {double(SHIFT)}, {large}, {small})"


def gamma_lower(k: Sql, x: Sql, weight: Sql) -> Sql:
    """P(k, x) by its series; for x up to k + 1."""
    return f"{weight} / {k} * " + _fold(f"20 + 9 * sqrt({k})", "1.0D", f"1.0D + s * {x} / ({k} + j)")


def gamma_upper(k: Sql, x: Sql, weight: Sql) -> Sql:
    """Q(k, x) = 1 - P(k, x) by Legendre's continued fraction; for x from k + 1."""
    count = f"floor(100 + 2 * sqrt({k}))"
    return f"{weight} / " + _fold(
        count, f"{x} + 2 * {count} + 1 - {k}", f"{x} + 2 * j - 1 - {k} - j * (j - {k}) / s")


def gamma_tails(k: Sql, t: Sql, x: Sql, weight: Sql) -> tuple[Sql, Sql]:
    """P and Q at x = k exp(t), each with small relative error where it is the smaller one."""
    low, high = gamma_lower(k, x, weight), gamma_upper(k, x, weight)
    near = f"{x} < {k} + 1"
    return f"if({near}, {low}, 1.0D - {high})", f"if({near}, 1.0D - {low}, {high})"


def beta_weight(a: Sql, b: Sql, t: Sql) -> Sql:
    """x^a (1 - x)^b / B(a, b) for t = logit x: the density of t."""
    ln_beta = f"(({log_gamma(a)}) + ({log_gamma(b)}) - ({log_gamma(f'({a} + {b})')}))"
    ln_x, ln_y = (f"(least({s}{t}, 0.0D) - log1p(exp(-abs({t}))))" for s in ("", "-"))
    return f"exp({a} * {ln_x} + {b} * {ln_y} - {ln_beta})"


def _beta_fraction(a: Sql, b: Sql, x: Sql, weight: Sql) -> Sql:
    """I_x(a, b) by its continued fraction; for x below (a + 1) / (a + b + 2)."""
    count = f"20 + 2 * sqrt(greatest({a}, {b}))"
    m = "(j - 1)"
    odd = f"({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1))"
    even = f"j * ({b} - j) * {x} / (({a} + 2 * j - 1) * ({a} + 2 * j))"
    return f"{weight} / {a} / " + _fold(count, "1.0D", f"1.0D - {odd} / (1.0D + {even} / s)")


def beta_tails(a: Sql, b: Sql, x: Sql, y: Sql, weight: Sql) -> tuple[Sql, Sql]:
    """I_x(a, b) and 1 - I_x(a, b), where y = 1 - x; each accurate where it is the smaller one."""
    low, high = _beta_fraction(a, b, x, weight), _beta_fraction(b, a, y, weight)
    near = f"{x} * ({a} + {b} + 2) < {a} + 1"
    return f"if({near}, {low}, 1.0D - {high})", f"if({near}, 1.0D - {low}, {high})"


def gamma_cdf_parts(k: Sql, x: Sql, name: str) -> list[Sql]:
    """Named columns for :func:`gamma_cdf`, in a projection below the one that uses them."""
    t = f"ln({x} / {k})"
    return [f"{k} as {name}_k", f"{x} as {name}_x", f"{t} as {name}_t", f"{gamma_weight(k, t)} as {name}_w"]


def gamma_cdf(name: str) -> Sql:
    """P(k, x) for x > 0, over the columns of :func:`gamma_cdf_parts`."""
    return gamma_tails(f"{name}_k", f"{name}_t", f"{name}_x", f"{name}_w")[0]


def beta_cdf_parts(a: Sql, b: Sql, x: Sql, name: str) -> list[Sql]:
    """Named columns for :func:`beta_cdf`; 0 < x < 1."""
    weight = beta_weight(a, b, f"ln({x} / (1.0D - {x}))")
    return [f"{a} as {name}_a", f"{b} as {name}_b", f"{x} as {name}_x", f"1.0D - {x} as {name}_y",
            f"{weight} as {name}_w"]


def beta_cdf(name: str) -> Sql:
    """I_x(a, b), over the columns of :func:`beta_cdf_parts`."""
    return beta_tails(*(f"{name}_{p}" for p in "abxyw"))[0]


def _fold_array(count: np.ndarray, start: np.ndarray, step: Callable, *columns: np.ndarray) -> np.ndarray:
    """:func:`_fold` for arrays: at each j, ``step(s, j, *columns)`` over the rows with so many terms."""
    order = np.argsort(-count, kind="stable")
    ends = np.searchsorted(-count[order], -np.arange(count.max(initial=0) + 1), "right")
    s, columns = start[order], [c[order] for c in columns]
    for j in range(len(ends) - 1, 0, -1):
        n = ends[j]
        s[:n] = step(s[:n], j, *(c[:n] for c in columns))
    out = np.empty_like(s)
    out[order] = s
    return out


def _terms(count: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(count), count, 0.0).astype(np.int64)


def _both(near: np.ndarray, low: Callable, high: Callable, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper tails: ``low`` gives the lower ones where ``near``, ``high`` the upper ones elsewhere."""
    found = np.empty(len(near))
    found[near], found[~near] = low(*(c[near] for c in columns)), high(*(c[~near] for c in columns))
    return np.where(near, found, 1.0 - found), np.where(near, 1.0 - found, found)


def gamma_tails_array(k: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`gamma_tails` for arrays, by the same series and fraction."""

    def low(k, x, weight):
        return weight / k * _fold_array(
            _terms(20 + 9 * np.sqrt(k)), np.ones(len(k)), lambda s, j, k, x: 1.0 + s * x / (k + j), k, x)

    def high(k, x, weight):
        count, rest = _terms(100 + 2 * np.sqrt(k)), x - k
        return weight / _fold_array(
            count, rest + 2 * count + 1, lambda s, j, k, rest: rest + (2 * j - 1) - j * (j - k) / s, k, rest)

    return _both(x < k + 1, low, high, k, x, weight)


def beta_tails_array(
    a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """:func:`beta_tails` for arrays, by the same fraction."""

    def step(s, j, a, b, x):
        m = j - 1
        odd = (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j))
        return 1.0 - odd / (1.0 + even / s)

    def fraction(a, b, x, weight):
        count = _terms(20 + 2 * np.sqrt(np.maximum(a, b)))
        return weight / a / _fold_array(count, np.ones(len(a)), step, a, b, x)

    return _both(
        x * (a + b + 2) < a + 1, lambda a, b, x, y, w: fraction(a, b, x, w),
        lambda a, b, x, y, w: fraction(b, a, y, w), a, b, x, y, weight)


def halley(t: np.ndarray, z: np.ndarray, tails: tuple[np.ndarray, np.ndarray], weight: np.ndarray,
           slope: np.ndarray) -> np.ndarray:
    """One step from t towards the point whose tails are those of the normal score z.

    ``weight`` is the density of t, ``slope`` the derivative of its logarithm.  The error
    after the step is of the order of the cube of the error before.
    """
    e = np.where(z < 0.0, tails[0] - normal_cdf_array(z), normal_cdf_array(-z) - tails[1]) / weight
    return t - e / (1.0 - 0.5 * e * slope)


def _stepped(found: Callable) -> Callable:
    """An Arrow function of double columns; a row with a null gives null."""

    def run(*columns: pa.Array) -> pa.Array:
        null = np.logical_or.reduce([np.asarray(c.is_null()) for c in columns])
        numbers = [c.fill_null(1.0).to_numpy(zero_copy_only=False) for c in columns]
        with np.errstate(all="ignore"):  # infinities and NaN come out as such, for the repair
            return pa.array(found(*numbers), mask=null)

    return run


@_stepped
def _gamma_step(k, t, x, weight, z):
    return halley(t, z, gamma_tails_array(k, x, weight), weight, k - x) * np.sqrt(k)


@_stepped
def _beta_step(a, b, t, x, y, weight, z):
    return halley(t, z, beta_tails_array(a, b, x, y, weight), weight, a - (a + b) * x) * np.sqrt(a + b)


def polish(rows: DataFrame, items: list[tuple[str, str, Sql, Sql, list[Sql]]]) -> DataFrame:
    """Add ``<name>_s``, an exact score, for each (family, name, score, z, shapes).

    ``score`` is an approximate one at the normal score ``z`` (a column), as the quantile
    functions read it: ``(ln x - ln k) * sqrt(k)`` for gamma(k), also for chi-squared with
    k = df / 2, and ``logit x * sqrt(a + b)`` for beta(a, b).  One Halley step with the
    incomplete gamma or beta function takes its error to that of the arithmetic.
    """
    kept = [ident(c) for c in rows.columns]
    first, second, third = [], [], []
    for family, name, score, z, shapes in items:
        t, x, w = f"{name}_t", f"{name}_x", f"{name}_w"
        if family == "beta":
            a, b, y = f"{name}_a", f"{name}_b", f"{name}_y"
            first += [f"{shapes[0]} as {a}", f"{shapes[-1]} as {b}",
                      f"({score}) / sqrt({shapes[0]} + {shapes[-1]}) as {t}"]
            second += [a, b, t, f"1.0D / (1.0D + exp(-{t})) as {x}", f"1.0D / (1.0D + exp({t})) as {y}",
                       f"{beta_weight(a, b, t)} as {w}"]
            exact = F.arrow_udf(_beta_step, "double")(*map(F.expr, (a, b, t, x, y, w, z)))
        else:
            k = f"{name}_k"
            first += [f"{shapes[0]} as {k}", f"({score}) / sqrt({shapes[0]}) as {t}"]
            second += [k, t, f"{k} * exp({t}) as {x}", f"{gamma_weight(k, t)} as {w}"]
            exact = F.arrow_udf(_gamma_step, "double")(*map(F.expr, (k, t, x, w, z)))
        third.append(exact.alias(f"{name}_s"))
    return rows.selectExpr(*kept, *first).selectExpr(*kept, *second).select(*map(F.expr, kept), *third)
