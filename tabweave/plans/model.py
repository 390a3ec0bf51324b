"""Fitting: a numeric table becomes four small tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.randomness import Rng
from tabweave.functions.text import ident, string
from tabweave.operators.dependence import normal_scores_at_scale, pairwise_correlation
from tabweave.operators.frequencies import category_frequencies, cumulate, smooth
from tabweave.operators.laws import FAMILIES, LAW_SCHEMA, choose_laws, fit_family, moments
from tabweave.operators.profile import DISCRETE_MAX, numeric_columns, profile, with_positives
from tabweave.operators.sample import bounded_sample
from tabweave.sources.scratch import Workspace, cut_lineage, freeze

MAX_COLUMNS = 5_000  # a wider table would make the d x d model itself large


@dataclass
class Model:
    """What generation needs to know about a table.

    profile      one row of statistics per numeric column
    laws         one row per modelled column: family and parameters
    frequencies  (col_name, value, p) of the discrete columns
    correlation  (col_i, col_j, rho) of the modelled columns' normal scores
    """

    columns: list[str]
    profile: DataFrame
    laws: DataFrame
    frequencies: DataFrame
    correlation: DataFrame

    @cached_property
    def statistics(self) -> dict[str, dict]:
        return {r["col_name"]: r.asDict() for r in self.profile.collect()}

    @cached_property
    def law_of(self) -> dict[str, tuple[str, dict[str, float]]]:
        """column -> (family, its parameters; None where undefined)."""
        return {
            r["col_name"]: (
                r["family"], {p: r[f"p_{p}"] for p in FAMILIES[r["family"]].fit}
            )
            for r in self.laws.collect()
        }

    @cached_property
    def categories(self) -> dict[str, list[tuple[float, float]]]:
        """discrete column -> [(value, cumulative smoothed share)]."""
        found: dict[str, list] = {}
        for r in cumulate(smooth(self.frequencies)).orderBy("col_name", "value").collect():
            found.setdefault(r["col_name"], []).append((r["value"], r["cum"]))
        return found

    @cached_property
    def pairs(self) -> dict[tuple[str, str], float]:
        return {(r["col_i"], r["col_j"]): r["rho"] for r in self.correlation.collect()}

    def correlation_matrix(self, cols: list[str]) -> np.ndarray:
        """The d x d matrix; missing or undefined pairs count as uncorrelated."""
        at = {c: i for i, c in enumerate(cols)}
        rho = np.eye(len(cols))
        for (a, b), value in self.pairs.items():
            if a in at and b in at and value is not None:
                rho[at[a], at[b]] = rho[at[b], at[a]] = value
        return rho


def fit_model(
    df: DataFrame,
    cols: list[str] | None = None,
    *,
    families: dict[str, str] | None = None,
    sample_limit: int | None = None,
    key_cols: list[str] | None = None,
    rng: Rng = Rng(),
    bias: str = "population",
    distinct: str = "exact",
    kurtosis: str = "excess",
    discrete_max: int = DISCRETE_MAX,
    numeric_types: str = "standard",
) -> Model:
    """Profile a whole table and fit laws, shares and dependence to all of it.

    ``families`` names the family of some columns; the others choose their own.  A
    named column is modelled by its law even if it has few values, and fitted to all
    its values.  Laws and profile come from one pass, shares from a second, ranks from a
    copy of the modelled columns in the shared folder, which is removed at the end.
    Only model rows reach the driver.

    ``sample_limit`` asks for laws, shares and dependence from an exact sample of so
    many rows (``bounded_sample``, by ``key_cols``) instead; the profile stays whole.
    """
    spark = df.sparkSession
    families = dict(families or {})
    cols = numeric_columns(df, numeric_types) if cols is None else list(cols)
    if len(cols) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} numeric columns")
    for name, family in families.items():
        if name not in cols or family not in FAMILIES:
            raise ValueError(f"no column {name!r} or no family {family!r}")
    if not cols:
        stats = profile(df, cols)
        return Model(
            [], stats,
            spark.createDataFrame([], LAW_SCHEMA),
            spark.createDataFrame([], "col_name string, value double, p double"),
            spark.createDataFrame([], "col_i string, col_j string, rho double"),
        )
    wide = freeze(
        with_positives(df, cols, bias=bias, distinct=distinct, discrete_max=discrete_max), len(cols)
    )
    if families:
        named = ", ".join(map(string, families))
        wide = freeze(wide.withColumn("is_binary", F.expr(f"is_binary and col_name not in ({named})")), len(cols))
    stats = wide.drop("n_pos", "avg_pos", "std_pos", "min_pos", "max_pos")
    rows = stats.orderBy("position").collect()
    modelled = [r["col_name"] for r in rows if not r["is_binary"]]
    discrete = [r["col_name"] for r in rows if r["is_binary"]]
    sampled = sample_limit is not None and rows[0]["n_rows"] > sample_limit
    source = df
    if sampled:
        wanted = list(dict.fromkeys([*cols, *(key_cols or [])]))
        source = cut_lineage(
            bounded_sample(df.select(*map(ident, wanted)), sample_limit, key_cols, rng)
        )

    def fit_laws():
        chosen = None
        own = [c for c in modelled if c not in families]
        if own:
            if sampled:
                positives = moments(source, own, positive_only=True)
            else:  # the profile pass has seen the same rows
                positives = wide.selectExpr(
                    "col_name", "n_pos as n", "avg_pos as mean", "std_pos as std",
                    "min_pos as min", "max_pos as max",
                )
            chosen = choose_laws(stats, positives, kurtosis).drop("position")
            chosen = chosen.where(F.col("col_name").isin(own))
        for family in sorted(set(families.values())):
            forced = [c for c, f in families.items() if f == family]
            part = fit_family(source, forced, family).drop("position")
            chosen = part if chosen is None else chosen.unionByName(part)
        return spark.createDataFrame([], LAW_SCHEMA) if chosen is None else freeze(chosen, len(modelled))

    def fit_frequencies():
        if not discrete:
            return spark.createDataFrame([], "col_name string, value double, p double")
        shares = category_frequencies(source, discrete).orderBy("col_name", "value")
        return freeze(shares, discrete_max * len(discrete))

    def fit_correlation():
        if len(modelled) < 2:
            return spark.createDataFrame([], "col_i string, col_j string, rho double")
        with Workspace(spark) as work:
            pairs = pairwise_correlation(normal_scores_at_scale(source, modelled, work.keep), modelled)
            return freeze(pairs, len(modelled) * (len(modelled) - 1) // 2)

    # three independent jobs; Spark runs them side by side
    with ThreadPoolExecutor(3) as pool:
        parts = [pool.submit(inheritable_thread_target(spark)(f))
                 for f in (fit_laws, fit_frequencies, fit_correlation)]
        laws, frequencies, correlation = (p.result() for p in parts)
    return Model(cols, stats, laws, frequencies, correlation)
