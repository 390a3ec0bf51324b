"""Profiles that merge: stored moment states and distinct sketches.

A state is one row per column.  States of the parts of a table add up to the state of
the whole, so a new part costs one pass over that part; no earlier row is read again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.repair import positive
from tabweave.operators.profile import DISCRETE_MAX, numeric_columns, per_column, statistics_of

_POS = positive("value")
_KEYS = "if(value is null, null, xxhash64(value + 0.0D))"  # + 0.0: one key for both zeros

STATE_SCHEMA = (
    "position int, col_name string, n_rows bigint, n bigint, n_zero bigint, mean double, "
    "m2 double, m3 double, m4 double, min double, max double, n_pos bigint, mean_pos double, "
    "m2_pos double, min_pos double, max_pos double, distinct_sketch binary"
)
_FIELDS = [f.split()[0] for f in STATE_SCHEMA.split(", ")]


def moment_states(df: DataFrame, cols: list[str] | None = None, numeric_types: str = "standard") -> DataFrame:
    """The state of a table: one pass, a row per column from each task.

    Counts, mean, sums of the second to fourth powers of distances from the mean, the
    same of positive values, extremes, and a sketch of the distinct values.  An empty
    table has a state of zeros and nulls.
    """
    cols = numeric_columns(df, numeric_types) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], STATE_SCHEMA)
    found = per_column(df, cols, {
        "n_rows": "count(*)",
        "n": "count(value)",
        "n_zero": "count(if(value = 0, 1, null))",
        "mean": "avg(value)",
        "spread": "var_pop(value)",
        "skew": "skewness(value)",
        "kurt": "kurtosis(value)",
        "min": "min(value)",
        "max": "max(value)",
        "n_pos": f"count({_POS})",
        "mean_pos": f"avg({_POS})",
        "spread_pos": f"var_pop({_POS})",
        "min_pos": f"min({_POS})",
        "max_pos": f"max({_POS})",
        "distinct_sketch": f"hll_sketch_agg({_KEYS})",
    })
    found = found.selectExpr(
        "*", "coalesce(if(min = max, 0.0D, n * spread), 0.0D) as m2",
        "coalesce(n_pos * spread_pos, 0.0D) as m2_pos",
    ).selectExpr(
        "*", "coalesce(skew * power(m2, 1.5D) / sqrt(n), 0.0D) as m3",
        "coalesce((kurt + 3) * m2 * m2 / n, 0.0D) as m4",
    )
    counts = {c: f"coalesce({c}, 0L) as {c}" for c in ("n_rows", "n", "n_zero", "n_pos")}
    return found.selectExpr(*(counts.get(c, c) for c in _FIELDS))


def merge_states(states: DataFrame) -> DataFrame:
    """The state of all parts together, in any order and grouping.

    Powers are moved from each part's mean to the common one, which keeps the digits that
    sums of raw powers lose; what is left is the rounding of the parts' means.  A column that some parts lack counts the rows of the others.
    """
    # one row per column on the right; means are averaged as steps from the least of them
    least = states.groupBy("col_name").agg(
        F.min("mean").alias("base"), F.min("mean_pos").alias("base_pos"))
    steps = states.join(F.broadcast(least), "col_name").selectExpr(
        "*", "coalesce(mean - base, 0.0D) as step", "coalesce(mean_pos - base_pos, 0.0D) as step_pos"
    )
    means = steps.groupBy("col_name").agg(
        F.expr("try_divide(sum(n * step), sum(n))").alias("mu"),
        F.expr("try_divide(sum(n_pos * step_pos), sum(n_pos))").alias("mu_pos"),
    )
    moved = steps.join(F.broadcast(means), "col_name").selectExpr(
        "*", "step - coalesce(mu, 0.0D) as d", "step_pos - coalesce(mu_pos, 0.0D) as d_pos"
    )
    sums = {
        "position": "min(position)",
        "n_rows": "sum(n_rows)",
        "n": "sum(n)",
        "n_zero": "sum(n_zero)",
        "mean": "any_value(base + mu)",
        "m2": "sum(m2 + n * d * d)",
        "m3": "sum(m3 + 3 * d * m2 + n * d * d * d)",
        "m4": "sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d)",
        "min": "min(min)",
        "max": "max(max)",
        "n_pos": "sum(n_pos)",
        "mean_pos": "any_value(base_pos + mu_pos)",
        "m2_pos": "sum(m2_pos + n_pos * d_pos * d_pos)",
        "min_pos": "min(min_pos)",
        "max_pos": "max(max_pos)",
        "distinct_sketch": "hll_union_agg(distinct_sketch, true)",
    }
    return moved.groupBy("col_name").agg(
        *(F.expr(total).alias(name) for name, total in sums.items())
    ).select(*_FIELDS)


def profile_of_states(
    states: DataFrame, *, bias: str = "population", discrete_max: int = DISCRETE_MAX
) -> DataFrame:
    """The profile, with the moments of positive values, of merged states.

    The columns are those of ``with_positives``, so ``choose_laws`` takes it for both its
    tables.  ``unique_count`` is the sketch's estimate: up to some hundreds the number of
    distinct values (of their 64-bit hashes, as doubles), with an error of about 2 %
    beyond.  ``bias`` is that of ``profile``.
    """
    if bias not in ("population", "sample"):
        raise ValueError(f"bias must be 'population' or 'sample', not {bias!r}")
    spread = "if(min < max and m2 > 0, m2, null)"
    return statistics_of(states.selectExpr(
        "position", "col_name", "n_rows", "n", "n_zero", "min", "max", "n_pos", "min_pos", "max_pos",
        "mean as avg_all", "mean_pos as avg_pos",
        "if(n > 1, sqrt(if(min = max, 0.0D, m2) / (n - 1)), null) as std_all",
        "if(n_pos > 0, sqrt(if(min_pos = max_pos, 0.0D, m2_pos) / n_pos), null) as std_pos",
        f"sqrt(n) * m3 / power({spread}, 1.5D) as skew_pop",
        f"n * m4 / ({spread} * {spread}) - 3 as kurt_pop",
        "hll_sketch_estimate(distinct_sketch) as unique_count",
    ), "coalesce(unique_count, 0L)", bias, discrete_max)


def store_state(states: DataFrame, folder: str, part: str) -> None:
    """Keep the state of a part in a folder of states; the same part again replaces it."""
    if not re.fullmatch(r"[\w.-]+", part):
        raise ValueError(f"a part's name may hold letters, digits and _ . - only, not {part!r}")
    states.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/part={part}")


def stored_states(spark: SparkSession, folder: str) -> DataFrame:
    """The states of all parts in a folder."""
    return spark.read.schema(STATE_SCHEMA).parquet(folder)
