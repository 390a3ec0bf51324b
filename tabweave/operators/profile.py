"""Column selection and the one-pass profile of a numeric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.repair import nan_to_null, positive
from tabweave.functions.text import Sql, ident, string
from tabweave.sources.scratch import freeze

# The column types that count as numeric, by Spark type name.
NUMERIC_TYPES = ("integer", "long", "double", "float")
NARROW_TYPES = ("byte", "short", "decimal")

DISCRETE_MAX = 10  # fixed value: at most this many distinct values = discrete
SURELY_MANY = 8    # an estimate this many times DISCRETE_MAX cannot be a discrete column

PROFILE_SCHEMA = (
    "position int, col_name string, mean double, std double, mean_nonzero double, "
    "std_nonzero double, skewness double, kurtosis double, min double, max double, "
    "is_binary boolean, unique_count bigint, zero_ratio double, n_rows bigint"
)


def numeric_columns(df: DataFrame, numeric_types: str = "standard") -> list[str]:
    """Names of the numeric columns in source order.

    ``numeric_types="all"`` also takes byte, short and decimal columns.
    """
    allowed = NUMERIC_TYPES + (NARROW_TYPES if numeric_types == "all" else ())
    return [f.name for f in df.schema.fields if f.dataType.typeName() in allowed]


def column_roles(df: DataFrame, numeric_types: str = "standard") -> list[tuple[str, str, str]]:
    """(name, type, role) of every source column, role 'numeric' or 'ignored'."""
    chosen = set(numeric_columns(df, numeric_types))
    return [
        (f.name, f.dataType.simpleString(), "numeric" if f.name in chosen else "ignored")
        for f in df.schema.fields
    ]


def number(col_name: str) -> Sql:
    """A source column as a double, NaN turned to null."""
    return nan_to_null(f"cast({ident(col_name)} as double)")


def tall(df: DataFrame, cols: list[str], keep: list[Sql] = []) -> DataFrame:
    """Unpivot to (kept columns, position, value double), one row per cell.

    Tall rows keep the generated code the same size for 5 columns and for 500.
    Followed by an aggregate they never leave their task: what is shuffled is
    one partial row per column (or distinct value) and task.
    """
    cells = ", ".join(f"{i}, {number(c)}" for i, c in enumerate(cols))
    return df.selectExpr(*keep, f"stack({len(cols)}, {cells}) as (position, value)")


def named(cols: list[str], position: Sql = "position") -> Sql:
    """Column name for a position, by lookup in a literal array."""
    return f"get(array({', '.join(map(string, cols))}), {position})"


def per_column(df: DataFrame, cols: list[str], measures: dict[str, Sql]) -> DataFrame:
    """Aggregates over ``value`` for every column: (position, col_name, measures).

    Columns without any row get a row of nulls, so an empty table still has a
    profile.  Both sides of the join hold one row per column.
    """
    found = tall(df, cols).groupBy("position").agg(
        *(F.expr(agg).alias(name) for name, agg in measures.items())
    )
    every = df.sparkSession.range(0, len(cols), 1, 1).selectExpr(
        "cast(id as int) as position", f"{named(cols, 'cast(id as int)')} as col_name"
    )
    return every.join(F.broadcast(found), "position", "left")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact distinct non-null values per column: (col_name, unique_count).

    One shuffle of the distinct (column, value) pairs.  A value that fills a
    third of the table collapses on the map side, so there is no hot task.
    Whole numbers are compared as bigint: a double would merge large ids.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cells = []
    for i, c in enumerate(cols):
        if types[c] in ("byte", "short", "integer", "long"):
            cells.append(f"{i}, cast({ident(c)} as bigint), cast(null as double)")
        else:
            cells.append(f"{i}, cast(null as bigint), {number(c)}")
    return (
        df.selectExpr(f"stack({len(cols)}, {', '.join(cells)}) as (position, whole, real)")
        .where("whole is not null or real is not null")
        .distinct()
        .groupBy("position")
        .agg(F.count("*").alias("unique_count"))
        .selectExpr(f"{named(cols)} as col_name", "unique_count")
    )


_POS = positive("value")
MEASURES: dict[str, Sql] = {
    "n_rows": "count(*)",
    "n": "count(value)",
    "avg_all": "avg(value)",
    "std_all": "stddev_samp(value)",
    "skew_pop": "skewness(value)",
    "kurt_pop": "kurtosis(value)",
    "min": "min(value)",
    "max": "max(value)",
    "n_pos": f"count({_POS})",
    "avg_pos": f"avg({_POS})",
    "std_pos": f"stddev_pop({_POS})",
    "min_pos": f"min({_POS})",
    "max_pos": f"max({_POS})",
    "n_zero": "count(if(value = 0, 1, null))",
}


def _bias_corrected() -> tuple[Sql, Sql]:
    """Sample skewness and excess kurtosis from the population ones."""
    g1 = "if(n > 2, skew_pop * try_divide(sqrt(double(n) * (n - 1)), double(n - 2)), null)"
    g2 = (
        "if(n > 3, try_divide(double(n - 1), double(n - 2) * (n - 3))"
        " * ((n + 1) * kurt_pop + 6), null)"
    )
    return g1, g2


def profile(
    df: DataFrame,
    cols: list[str] | None = None,
    *,
    bias: str = "population",
    distinct: str = "exact",
    discrete_max: int = DISCRETE_MAX,
    numeric_types: str = "standard",
) -> DataFrame:
    """One row of statistics per numeric column.

    ``bias="sample"`` gives bias-corrected skewness and kurtosis and an n-1
    standard deviation of the positive values.

    ``distinct="exact"`` counts distinct values, which shuffles them.
    ``distinct="approximate"`` (for very large tables) estimates the counts in the
    profile pass and counts exactly only the columns that may be discrete: those
    estimated at up to SURELY_MANY times ``discrete_max``.  Estimates have a
    standard error of 5 %; ``is_binary`` is exact either way.
    """
    return with_positives(
        df, cols, bias=bias, distinct=distinct, discrete_max=discrete_max,
        numeric_types=numeric_types,
    ).drop("n_pos", "avg_pos", "std_pos", "min_pos", "max_pos")


def with_positives(
    df: DataFrame,
    cols: list[str] | None = None,
    *,
    bias: str = "population",
    distinct: str = "exact",
    discrete_max: int = DISCRETE_MAX,
    numeric_types: str = "standard",
) -> DataFrame:
    """:func:`profile` with the moments of the positive values from the same pass."""
    if bias not in ("population", "sample"):
        raise ValueError(f"bias must be 'population' or 'sample', not {bias!r}")
    if distinct not in ("exact", "approximate"):
        raise ValueError(f"distinct must be 'exact' or 'approximate', not {distinct!r}")
    cols = numeric_columns(df, numeric_types) if cols is None else list(cols)
    if not cols:
        extra = "".join(f", {c} double" for c in ("n_pos", "avg_pos", "std_pos", "min_pos", "max_pos"))
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA + extra)
    if distinct == "exact":
        counts, rest = "unique_count", cols
        moments = per_column(df, cols, MEASURES)
    else:
        # a model table of one row per column, pinned to choose the columns to count
        moments = freeze(
            per_column(df, cols, MEASURES | {"estimate": "approx_count_distinct(value)"}), len(cols))
        counts = "coalesce(unique_count, estimate)"
        rest = [r["col_name"] for r in moments.collect()
                if (r["estimate"] or 0) <= SURELY_MANY * discrete_max]
    if rest:
        # one row per column on either side
        moments = moments.join(F.broadcast(distinct_counts(df, rest)), "col_name", "left")
    else:
        moments = moments.withColumn("unique_count", F.lit(None).cast("bigint"))
    return statistics_of(moments, f"coalesce({counts}, 0L)", bias, discrete_max)


def statistics_of(moments: DataFrame, unique: Sql, bias: str, discrete_max: int) -> DataFrame:
    """Profile rows, with moments of the positive values, from rows of MEASURES."""
    skew, kurt, std_pos = "skew_pop", "kurt_pop", "std_pos"
    if bias == "sample":
        skew, kurt = _bias_corrected()
        std_pos = "std_pos * sqrt(try_divide(double(n_pos), double(n_pos - 1)))"
    return moments.selectExpr(
        "position",
        "col_name",
        "coalesce(avg_all, 0.0D) as mean",
        "coalesce(std_all, 0.0D) as std",
        "if(n_pos > 0, avg_pos, coalesce(avg_all, 0.0D)) as mean_nonzero",
        f"if(n_pos > 0, {std_pos}, coalesce(std_all, 0.0D)) as std_nonzero",
        f"coalesce({skew}, 0.0D) as skewness",
        f"coalesce({kurt}, 0.0D) as kurtosis",
        "min",
        "max",
        f"coalesce({unique} <= {int(discrete_max)}, false) as is_binary",
        f"{unique} as unique_count",
        "try_divide(double(n_zero), double(n_rows)) as zero_ratio",
        "coalesce(n_rows, 0L) as n_rows",
        "n_pos", "avg_pos", "std_pos", "min_pos", "max_pos",
    )

