"""Category frequencies of low-cardinality columns and their smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.text import Sql, double
from tabweave.operators.profile import named, tall

SMOOTHING = 0.01  # fixed value: added to every category share
WRITTEN_OUT = 32  # categories up to which a draw is a CASE expression, which is compiled


def category_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of each value per column: (col_name, value, p), nulls left out.

    Counts collapse on the map side; the totals have one row per column, so the
    join back to them is a broadcast of at most ``len(cols)`` rows.
    """
    counts = (
        tall(df, cols).where("value is not null")
        .groupBy("position", "value").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("position").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "position").selectExpr(
        f"{named(cols)} as col_name", "value", "n / total as p"
    )


def smooth(frequencies: DataFrame, epsilon: float = SMOOTHING) -> DataFrame:
    """Laplace smoothing of the shares within each column."""
    e = double(epsilon)
    totals = frequencies.groupBy("col_name").agg(
        F.expr(f"sum(p) + {e} * count(*)").alias("total")
    )
    return frequencies.join(F.broadcast(totals), "col_name").selectExpr(
        "col_name", "value", f"(p + {e}) / total as p"
    )


def cumulate(smoothed: DataFrame) -> DataFrame:
    """Add ``cum``, the running share by value; a column has at most ``discrete_max`` rows."""
    order = Window.partitionBy("col_name").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return smoothed.withColumn("cum", F.sum("p").over(order))


def draw_category(u: Sql, categories: list[tuple[float, float]]) -> Sql:
    """Pick a value by inverse CDF; ``categories`` is [(value, cumulative share)].

    The last category takes whatever rounding leaves above its running share.  Beyond
    WRITTEN_OUT categories the running shares are arrays of the plan, with a guide that
    tells where each of n equal slices of (0, 1) begins among them: a draw compares with the
    shares in its slice, which are one or two on average however they are spread.
    """
    if not categories:
        return "cast(null as double)"
    *head, (last, _) = categories
    if not head:
        return double(last)
    if len(categories) <= WRITTEN_OUT:
        cases = " ".join(f"when {u} < {double(cum)} then {double(v)}" for v, cum in head)
        return f"case {cases} else {double(last)} end"
    n, shares = len(categories), np.maximum.accumulate([cum for _, cum in head])
    slices = np.arange(n)
    # a little wider than the slices, so that rounding of u * n does not matter
    first = np.searchsorted(shares, (slices - 0.001) / n, "right")
    inside = np.searchsorted(shares, (slices + 1.001) / n, "right") - first
    at = f"cast(least(floor(v * {double(n)}), {n - 1}L) as int)"
    own = f"slice({_array(shares)}, 1 + get({_array(first)}, {at}), get({_array(inside)}, {at}))"
    index = f"get({_array(first)}, {at}) + size(filter({own}, c -> c <= v))"
    values = _array(np.array([float(v) for v, _ in categories]))
    return f"get(transform(array({u}), v -> get({values}, {index})), 0)"


def _array(numbers: np.ndarray) -> Sql:
    """An array literal of ints or doubles."""
    write = double if numbers.dtype.kind == "f" else str
    return f"array({', '.join(write(x) for x in numbers.tolist())})"
