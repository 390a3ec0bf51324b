"""Registered queries: every operator over whole tables.

Each function takes (spark, folder) and returns a DataFrame.  Random operators
use the MD5 generator, so that another SQL engine can compute the same values.
Values are rounded at this boundary only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import special
from tabweave.functions.normal import normal_cdf, normal_quantile, quantile_parts
from tabweave.functions.randomness import Rng, between
from tabweave.functions.repair import (
    clip, clip_percentile, clip_range, inject_zero, nan_to_null, repair,
)
from tabweave.functions.scores import ScorePolynomial
from tabweave.functions.text import Sql, double, ident
from tabweave.operators import draws, laws
from tabweave.operators.dependence import (
    average_ranks, correlation_factor, normal_scores, normal_scores_at_scale, pairwise_correlation,
)
from tabweave.operators.frequencies import category_frequencies, cumulate, draw_category, smooth
from tabweave.operators.profile import numeric_columns, per_column, profile, tall, with_positives
from tabweave.operators.sample import bounded_sample
from tabweave.operators.states import merge_states, moment_states, profile_of_states, store_state, stored_states
from tabweave.operators.uncertainty import MODES, factor, fallback_normal, widen
from tabweave.plans import runs
from tabweave.plans.files import write_levels
from tabweave.plans.generate import generate
from tabweave.plans.model import fit_model
from tabweave.sources.csv import read_csv, read_sweep, write_sweep
from tabweave.sources.scratch import Workspace, freeze

RNG = Rng(seed=42, portable=True)
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINEITEM_MODELLED = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
]
SWEEP = (0.0, 0.05, 0.1, 0.2, 0.3)  # fixed values: default indeterminacy levels
BLOCK = 100                         # rows per block in the fuzz queries
GROUPS = 1000                       # rows of a summary whose files go before it is returned, at most
STATISTICS = ("mean", "std", "mean_nonzero", "std_nonzero", "min", "max")
SHAPE_STATISTICS = ("skewness", "kurtosis", "zero_ratio")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns; adding zero removes negative zeros."""
    return df.selectExpr(*(
        f"round({ident(c)}, {digits[c]}) + 0.0D as {ident(c)}" if c in digits else ident(c)
        for c in df.columns
    ))


# --- sources and sinks -------------------------------------------------------

@query("csv_roundtrip")
def csv_roundtrip(spark, folder):
    """Write a table as CSV to the shared folder and read it with inferred types."""
    with Workspace(spark) as work:
        path = f"{work.folder}/orders-csv"
        table(spark, folder, "orders").write.option("header", True).csv(path)
        back = read_csv(spark, path)
        types = F.lit(",".join(kind for _, kind in back.dtypes))
        return freeze(rounded(
            back.groupBy("o_orderstatus").agg(
                F.count("*").alias("n_rows"),
                F.max("o_orderkey").cast("bigint").alias("max_key"),
                F.sum("o_totalprice").alias("total"),
                F.max(F.year("o_orderdate")).cast("bigint").alias("last_year"),
            ).withColumn("types", types),
            {"total": 2},
        ), GROUPS)


@query("csv_sweep_roundtrip")
def csv_sweep_roundtrip(spark, folder):
    """Generate a sweep, write it partitioned by level, read one level per folder."""
    source = table(spark, folder, "customer")
    with Workspace(spark) as work:
        path = f"{work.folder}/customer-sweep"
        model = fit_model(source, key_cols=["c_custkey"], rng=RNG)
        write_sweep(generate(spark, model, source.count(), SWEEP, rng=RNG, block_rows=BLOCK), path)
        back = read_sweep(
            spark, path, "c_custkey double, c_nationkey double, c_acctbal double, in_level double"
        )
        columns = ("c_custkey", "c_nationkey", "c_acctbal")
        return freeze(rounded(
            back.groupBy("in_level").agg(
                F.count("*").alias("n_rows"), *(F.avg(c).alias(f"avg_{c}") for c in columns)
            ),
            {f"avg_{c}": 3 for c in columns},
        ), GROUPS)


@query("generate_files")
def generate_files(spark, folder):
    """Read, fit, generate, write a data set for each level, and log it; rows as read back."""
    source = table(spark, folder, "customer")
    with Workspace(spark) as work:
        path = f"{work.folder}/customer-files"
        model = fit_model(source, rng=RNG)
        log = write_levels(spark, model, source.count(), SWEEP, path, rng=RNG)
        back = spark.read.option("header", True).csv(f"{path}/*.csv").select(
            F.element_at(F.split(F.input_file_name(), "/"), -2).alias("filename")
        ).groupBy("filename").agg(F.count("*").alias("n_rows"))
        return freeze(runs.log_levels(log).join(back, "filename").select("in_level", "files", "n_rows", "filename"), GROUPS)


@query("row_ids")
def row_ids(spark, folder):
    """As many consecutive ids as the table has rows."""
    n = table(spark, folder, "orders").count()
    return spark.range(0, n, 1, max(8, n // 4_000_000))


# --- columns and statistics --------------------------------------------------

@query("numeric_columns")
def numeric_column_counts(spark, folder):
    """The numeric columns of a table, in order, with their non-null values."""
    df = table(spark, folder, "lineitem")
    return per_column(df, numeric_columns(df), {"non_null": "count(value)"})


def profiled(df: DataFrame, **options) -> DataFrame:
    return rounded(
        profile(df, **options).drop("position", "n_rows"),
        {**{c: 4 for c in STATISTICS}, **{c: 6 for c in SHAPE_STATISTICS}},
    )


for _name in ("lineitem", "customer", "orders", "part", "events", "documents"):
    QUERIES[f"profile_{_name}"] = (
        lambda spark, folder, name=_name: profiled(table(spark, folder, name))
    )


@query("profile_sample_bias")
def profile_sample_bias(spark, folder):
    """Bias-corrected moments, as the single-machine profile has them."""
    return profiled(table(spark, folder, "orders"), bias="sample")


@query("profile_flags")
def profile_flags(spark, folder):
    """The profile without the shuffle of most distinct values; flags stay exact."""
    return profiled(table(spark, folder, "lineitem"), distinct="approximate").drop("unique_count")


def merged_parts(spark, df: DataFrame, part: Sql, cols: list[str]) -> DataFrame:
    """The profile of a table that arrived in three parts, from their stored states alone."""
    with Workspace(spark) as work:
        for i in range(3):
            arrived = df.where(f"coalesce(pmod({part}, 3), 0) = {i}")
            store_state(moment_states(arrived, cols), work.folder, str(i))
        # a row per column
        return freeze(profile_of_states(merge_states(stored_states(spark, work.folder))), len(cols))


@query("profile_merged")
def profile_merged(spark, folder):
    """Lines arrive in parts by line number, so that its values differ from part to part."""
    lines = table(spark, folder, "lineitem")
    found = merged_parts(spark, lines, "l_linenumber div 2", numeric_columns(lines))
    shown = found.select(
        "col_name", *STATISTICS, *SHAPE_STATISTICS, "is_binary",
        F.expr("least(unique_count, 11L)").alias("distinct_up_to_11"), "n_rows")
    return rounded(shown, dict.fromkeys(STATISTICS, 4) | dict.fromkeys(SHAPE_STATISTICS, 6))


@query("choose_family_merged")
def choose_family_merged(spark, folder):
    """Families chosen from the stored states of orders and customers, without their rows."""
    found = None
    for name, part in (("orders", "o_orderkey"), ("customer", "c_nationkey")):
        df = table(spark, folder, name)
        stats = merged_parts(spark, df, part, numeric_columns(df))
        positives = stats.selectExpr(
            "col_name", "n_pos as n", "avg_pos as mean", "std_pos as std", "min_pos as min", "max_pos as max")
        part = laws.choose_laws(stats, positives).drop("position")
        found = part if found is None else found.unionByName(part)
    return shown_laws(found)


@query("positive_moments")
def positive_moments(spark, folder):
    """Moments of the positive values; c_acctbal has negative ones."""
    found = laws.moments(table(spark, folder, "customer"), ["c_acctbal"], positive_only=True)
    return rounded(
        found.drop("position"),
        {"mean": 4, "std": 4, "min": 4, "max": 4, "log_mean": 6, "log_std": 6},
    )


@query("zero_ratio")
def zero_ratio(spark, folder):
    found = profile(table(spark, folder, "lineitem"), ["l_discount", "l_tax"])
    return rounded(found.select("col_name", "zero_ratio"), {"zero_ratio": 9})


@query("discrete_flags")
def discrete_flags(spark, folder):
    return profile(table(spark, folder, "lineitem")).select("col_name", "unique_count", "is_binary")


@query("category_frequencies")
def frequencies(spark, folder):
    return rounded(
        category_frequencies(table(spark, folder, "lineitem"), ["l_linenumber", "l_tax"])
        .unionByName(category_frequencies(table(spark, folder, "labels"), ["quality", "toxic"])),
        {"p": 9},
    )


@query("smoothed_frequencies")
def smoothed_frequencies(spark, folder):
    found = category_frequencies(table(spark, folder, "lineitem"), ["l_linenumber", "l_tax"])
    return rounded(cumulate(smooth(found)), {"p": 9, "cum": 9})


@query("bounded_sample")
def sampled(spark, folder):
    """1000 orders, the same on every cluster."""
    return bounded_sample(table(spark, folder, "orders"), 1000, ["o_orderkey"], RNG).select(
        "o_orderkey", "o_totalprice"
    )


@query("bounded_sample_half")
def sampled_half(spark, folder):
    """Half of all line items: no task holds the sample."""
    lines = table(spark, folder, "lineitem")
    return bounded_sample(lines, lines.count() // 2, LINEITEM_KEY, RNG).select(*LINEITEM_KEY, "l_quantity")


# --- laws --------------------------------------------------------------------

FIT_COLUMNS = (
    ("orders", ["o_totalprice"]), ("part", ["p_retailprice", "p_size"]), ("events", ["value"]),
)
REAL_PARAMETERS = [f"p_{p}" for p in laws.PARAMETERS if p != "df"]


def shown_laws(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(
        df.withColumn("p_df", F.col("p_df").cast("double")), {c: digits for c in REAL_PARAMETERS}
    )


def fitted(spark, folder, family: str) -> DataFrame:
    found = None
    for name, cols in FIT_COLUMNS:
        part = laws.fit_family(table(spark, folder, name), cols, family).drop("position")
        found = part if found is None else found.unionByName(part)
    return shown_laws(found)


def chosen(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Statistics and moments of the positives come from one pass."""
    found = freeze(with_positives(df, cols), 1000)
    positives = found.selectExpr(
        "col_name", "n_pos as n", "avg_pos as mean", "std_pos as std", "min_pos as min", "max_pos as max"
    )
    return laws.choose_laws(found, positives).drop("position")


@query("choose_family")
def choose_family(spark, folder):
    found = None
    for name in ("lineitem", "orders", "customer", "part", "events", "documents"):
        part = chosen(table(spark, folder, name))
        found = part if found is None else found.unionByName(part)
    return shown_laws(found)


def derived(spark, folder) -> DataFrame:
    """Columns that reach every branch of the automatic choice, from order keys."""
    def u(tag: str) -> Sql:
        return RNG.uniform("o_orderkey", f"derived/{tag}")

    def heavy(power: float) -> Sql:
        return f"100 + if(s < 0.5, -1, 1) * power(-ln(e), {double(power)})"

    orders = table(spark, folder, "orders")
    base = orders.selectExpr("o_orderkey", *(f"{u(t)} as {t}" for t in "abcdefghqs"))
    base = base.selectExpr(
        "*", "sqrt(-2 * ln(g)) * cos(2 * pi() * h) as z", "-100 * ln(e) as expo"
    )
    return base.selectExpr(
        "o_orderkey",
        "if(o_orderkey < 5, 1 + o_orderkey, -f) as fewpos",
        "f as frac",
        "expo",
        "10 * exp(0.4D * z) as lognorm",
        "-ln(a) - ln(b) - ln(c) - ln(d) as erlang4",
        f"{heavy(1.0)} as laplace",
        "z + 10 as gauss",
        f"{heavy(1.3)} as heavy",
        f"{heavy(0.9)} as mid",
        "if(q < 0.3, 0, expo) as zeroinfl",
        "double(floor(5 * f)) as disc",
    )


DERIVED = [
    "fewpos", "frac", "expo", "lognorm", "erlang4", "laplace", "gauss", "heavy", "mid", "zeroinfl",
    "disc",
]


@query("choose_family_derived")
def choose_family_derived(spark, folder):
    return shown_laws(chosen(derived(spark, folder), DERIVED))


@query("choose_family_raw_kurtosis")
def choose_family_raw_kurtosis(spark, folder):
    df = derived(spark, folder)
    return shown_laws(
        laws.choose_laws(
            profile(df, DERIVED), laws.moments(df, DERIVED, positive_only=True), kurtosis="raw"
        ).drop("position")
    )


# --- dependence --------------------------------------------------------------

@query("average_ranks")
def ranks(spark, folder):
    """Average ranks of every distinct value, without a global sort task."""
    df = table(spark, folder, "lineitem")
    cells = tall(df, ["l_quantity", "l_extendedprice"]).where("value is not null")
    return average_ranks(cells).selectExpr("position", "value", "ties", "rank")


@query("normal_score_corr")
def normal_score_corr(spark, folder):
    """Correlation of normal scores over the whole table."""
    df = table(spark, folder, "lineitem")
    scores = normal_scores_at_scale(df, LINEITEM_MODELLED)
    return rounded(pairwise_correlation(scores, LINEITEM_MODELLED), {"rho": 7})


@query("normal_score_corr_sample")
def normal_score_corr_sample(spark, folder):
    """The same over an exact sample of 5000 rows."""
    sample = bounded_sample(table(spark, folder, "lineitem"), 5000, LINEITEM_KEY, RNG)
    scores = normal_scores(sample, LINEITEM_MODELLED)
    return rounded(pairwise_correlation(scores, LINEITEM_MODELLED), {"rho": 7})


# --- indeterminacy -----------------------------------------------------------

def order_blocks(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .selectExpr(f"o_orderkey div {BLOCK} as block").groupBy("block").agg(F.count("*").alias("n_rows"))
    )


def fuzzed(spark, folder, mode: str) -> DataFrame:
    """All eight laws of the order price, widened for every block of orders."""
    orders = table(spark, folder, "orders")
    blocks = order_blocks(spark, folder)
    structs = []
    known = freeze(laws.moments(orders, ["o_totalprice"]), 1)
    fits = {f: laws.FAMILIES[f].fit for f in EIGHT}
    row = known.selectExpr(*(f"{x} as {f}_{p}" for f in EIGHT for p, x in fits[f].items())).first()
    for family in map(laws.FAMILIES.get, EIGHT):
        params = {
            p: str(row[f"{family.name}_{p}"]) if p == "df" else double(row[f"{family.name}_{p}"])
            for p in family.fit
        }
        moved = widen(params, MODES[mode](RNG, "block", 0.1, family.name))
        structs.append(laws.law(family.name, **moved))
    return shown_laws(blocks.selectExpr("block", f"inline(array({', '.join(structs)}))"), 5)


EIGHT = ("normal", "lognormal", "gamma", "exponential", "weibull", "beta", "uniform", "chi2")


@query("fuzz_fallback_normal")
def fuzz_fallback_normal(spark, folder):
    """A column without a law: mean and deviation of its positives move apart."""
    stats = profile(table(spark, folder, "orders"), ["o_totalprice"]).first()
    moved = fallback_normal(
        stats["mean_nonzero"], stats["std_nonzero"],
        MODES["independent"](RNG, "block", 0.2, "o_totalprice"),
    )
    return rounded(
        order_blocks(spark, folder).selectExpr(
            "block", f"{moved['loc']} as mu", f"{moved['scale']} as sigma"
        ),
        {"mu": 4, "sigma": 4},
    )


@query("in_sweep")
def in_sweep(spark, folder):
    """One factor per block and level."""
    levels = ", ".join(double(x) for x in SWEEP)
    return rounded(
        order_blocks(spark, folder)
        .selectExpr("block", f"explode(array({levels})) as in_level")
        .selectExpr("block", "in_level", f"{factor(RNG, 'block', 'in_level', 'o_totalprice/g')} as g"),
        {"g": 12},
    )


# --- draws -------------------------------------------------------------------

@query("uniform_draw")
def uniform_draw(spark, folder):
    u = between(RNG.uniform("o_orderkey", "price/u"), 0.001, 0.999)
    return rounded(table(spark, folder, "orders").selectExpr("o_orderkey", f"{u} as u"), {"u": 12})


def correlated(spark, folder) -> DataFrame:
    """Two correlated normals per order, with the correlation of two of its columns."""
    orders = table(spark, folder, "orders")
    cols = ["o_custkey", "o_totalprice"]
    rho = pairwise_correlation(normal_scores_at_scale(orders, cols), cols).first()["rho"]
    factors = correlation_factor([[1.0, rho], [rho, 1.0]])
    radius, angle = RNG.polar("o_orderkey", "copula/0")
    return (
        orders.selectExpr("o_orderkey", f"{radius} as r", f"{angle} as a")
        .selectExpr("o_orderkey", "r * cos(a) as e0", "r * sin(a) as e1")
        .selectExpr(
            "o_orderkey", f"{double(factors[0, 0])} * e0 as z0",
            f"{double(factors[1, 0])} * e0 + {double(factors[1, 1])} * e1 as z1",
        )
    )


@query("correlated_normals")
def correlated_normals(spark, folder):
    return rounded(correlated(spark, folder), {"z0": 8, "z1": 8})


@query("copula_uniforms")
def copula_uniforms(spark, folder):
    df = correlated(spark, folder).selectExpr(
        "o_orderkey", f"{normal_cdf('z0')} as u0", f"{normal_cdf('z1')} as u1"
    )
    return rounded(df, {"u0": 8, "u1": 8})


def fitted_params(spark, folder, family: str) -> dict[str, float]:
    row = laws.fit_family(table(spark, folder, "events"), ["value"], family).first()
    return {p: row[f"p_{p}"] for p in laws.FAMILIES[family].fit}


TABULATED = ("gamma", "chi2")  # laws without a closed form; beta(2, 2) has one


def quantiles(spark, folder, family: str) -> DataFrame:
    """The quantile of a clipped percentile per order."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    u = clip_percentile(RNG.uniform("o_orderkey", "quantile"))
    df = draws.evaluate(
        orders, u, "x", family, fitted_params(spark, folder, family), exact=family in TABULATED)
    return rounded(df, {"x": 4 if family in TABULATED else 6})


def drawn(spark, folder, family: str) -> DataFrame:
    """An independent draw per order."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    df = draws.draw(
        orders, "o_orderkey", "x", family, fitted_params(spark, folder, family), RNG, exact=family in TABULATED)
    return rounded(df, {"x": 4 if family in TABULATED else 6})


for _family in EIGHT:
    QUERIES[f"fit_{_family}"] = lambda s, f, family=_family: fitted(s, f, family)
    QUERIES[f"quantile_{_family}"] = lambda s, f, family=_family: quantiles(s, f, family)
    QUERIES[f"draw_{_family}"] = lambda s, f, family=_family: drawn(s, f, family)
for _mode in MODES:
    QUERIES[f"fuzz_{_mode}"] = lambda s, f, mode=_mode: fuzzed(s, f, mode)


def shape_of(tag: str, low: float, high: float) -> Sql:
    """A shape that moves from order to order."""
    return between(RNG.uniform("o_orderkey", f"shape/{tag}"), low, high)


@query("special_functions")
def special_functions(spark, folder):
    """ln Gamma and the regularised incomplete gamma and beta functions of moving arguments."""
    df = table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{shape_of('k', 0.05, 60.0)} as k", f"{shape_of('a', 0.2, 9.0)} as a",
        f"{shape_of('b', 0.2, 9.0)} as b", f"{RNG.uniform('o_orderkey', 'special/x')} as v",
    ).selectExpr("*", "k * (0.1D + 2 * v) as x")
    df = df.selectExpr(
        "o_orderkey", "k", "v", *special.gamma_cdf_parts("k", "x", "g"),
        *special.beta_cdf_parts("a", "b", "v", "c"),
    ).selectExpr(
        "o_orderkey", f"{special.log_gamma('k')} as log_gamma", f"{special.gamma_cdf('g')} as gamma_cdf",
        f"{special.beta_cdf('c')} as beta_cdf")
    return rounded(df, {"log_gamma": 8, "gamma_cdf": 8, "beta_cdf": 8})


@query("quantile_residuals")
def quantile_residuals(spark, folder):
    """Quantiles of moving shapes by the score polynomials, put back into the distribution function."""
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{clip_percentile(RNG.uniform('o_orderkey', 'residual'))} as u",
        f"{shape_of('gamma', 0.7, 1.3)} as gamma_k", f"{shape_of('chi2', 20.0, 60.0)} as chi2_k",
        f"{shape_of('beta', 1.6, 2.4)} as a", f"{shape_of('other', 1.6, 2.4)} as b")
    kept = ["o_orderkey", "u", "gamma_k", "chi2_k", "a", "b"]
    orders = orders.selectExpr(*kept, *quantile_parts("u", "n")).selectExpr(*kept, f"{normal_quantile('n')} as z")
    curves = {
        "gamma": (ScorePolynomial.of("gamma", [(0.7, 1.3)]), ["gamma_k"]),
        "chi2": (ScorePolynomial.of("chi2", [(20.0, 60.0)]), ["chi2_k"]),
        "beta": (ScorePolynomial.of("beta", [(1.6, 2.4), (1.6, 2.4)]), ["a", "b"]),
    }
    parts, values = [], []
    for name, (curve, shapes) in curves.items():
        found = curve.variables("z", shapes)
        parts += [f"{v} as {name}_{i}" for i, v in enumerate(found)]
        score = curve.score([f"{name}_{i}" for i in range(len(found))])
        values.append(f"1.0D / (1.0D + exp(-({score}) / sqrt(a + b))) as beta_x" if name == "beta"
                      else f"{shapes[0]} * exp(({score}) / sqrt({shapes[0]})) as {name}_x")
    df = orders.selectExpr(*kept, *parts).selectExpr(*kept, *values)
    df = df.selectExpr(
        "o_orderkey", "u", *(p for k in ("gamma", "chi2") for p in special.gamma_cdf_parts(f"{k}_k", f"{k}_x", f"{k}_f")),
        *special.beta_cdf_parts("a", "b", "beta_x", "beta_f"))
    cdf = {"gamma": special.gamma_cdf("gamma_f"), "chi2": special.gamma_cdf("chi2_f"), "beta": special.beta_cdf("beta_f")}
    df = df.selectExpr("o_orderkey", "u", *(f"abs({f} - u) < 1e-5D as {name}_within" for name, f in cdf.items()))
    return rounded(df, {"u": 9})


@query("empirical_quantile")
def empirical_quantile(spark, folder):
    """Rank look-up in a drawn and sorted sample, block by block."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    df = draws.empirical_quantile(
        orders, "o_orderkey", "o_orderkey div 1000",
        RNG.uniform("o_orderkey", "quantile"), "x", "exponential",
        fitted_params(spark, folder, "exponential"), RNG,
    )
    return rounded(df, {"x": 6})


@query("empirical_quantile_one_block")
def empirical_quantile_one_block(spark, folder):
    """The same with the whole table as one block."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    df = draws.empirical_quantile(
        orders, "o_orderkey", "0", RNG.uniform("o_orderkey", "quantile"), "x", "exponential",
        fitted_params(spark, folder, "exponential"), RNG,
    )
    return rounded(df, {"x": 6})


def category_per_order(spark, folder, column: str) -> DataFrame:
    """A value per order, from the smoothed shares of the line items' values."""
    shares = cumulate(smooth(category_frequencies(table(spark, folder, "lineitem"), [column])))
    found = [(r["value"], r["cum"]) for r in shares.orderBy("value").collect()]
    u = RNG.uniform("o_orderkey", f"{column}/category")
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{draw_category(u, found)} as {column}"
    )


@query("category_draw")
def category_draw(spark, folder):
    """A tax rate per order: nine categories, written out."""
    return category_per_order(spark, folder, "l_tax")


@query("category_draw_many")
def category_draw_many(spark, folder):
    """A supplier per order: a hundred categories at scale 0.01, read from arrays with a guide."""
    return category_per_order(spark, folder, "l_suppkey")


@query("zero_injection")
def zero_injection(spark, folder):
    ratio = profile(table(spark, folder, "lineitem"), ["l_discount"]).first()["zero_ratio"]
    u = RNG.uniform("o_orderkey", "price/zero")
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{inject_zero('o_totalprice', u, ratio)} as price"
    )


@query("percentile_clip")
def percentile_clip(spark, folder):
    u = RNG.uniform("event_id", "clip")
    return rounded(
        table(spark, folder, "events").selectExpr(
            "event_id", f"{clip_percentile(u)} as spark_path",
            f"{clip_percentile(u, 0.001)} as sequential_path", f"{clip(u, 0.6, 0.4)} as crossed",
        ),
        {"spark_path": 12, "sequential_path": 12},
    )


@query("range_clip")
def range_clip(spark, folder):
    """Balances stretched beyond their range and clipped back to it."""
    df = table(spark, folder, "customer")
    s = profile(df, ["c_acctbal"]).first()
    return rounded(
        df.selectExpr(
            "c_custkey", f"{clip_range('c_acctbal * 1.5D - 1000.0D', s['min'], s['max'])} as balance",
            f"{clip_range('c_acctbal', -10.0, -9.5)} as crossed",
            f"{clip_range('c_acctbal', None, s['max'])} as open_below",
        ),
        {"balance": 6, "crossed": 6, "open_below": 6},
    )


@query("nan_repair")
def nan_repair(spark, folder):
    """Impossible values are replaced before the range clip."""
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_acctbal",
        "case c_custkey % 4 when 0 then double('NaN') when 1 then double('Infinity')"
        " when 2 then double('-Infinity') else c_acctbal end as x",
    )
    s = profile(df, ["c_acctbal"]).first()
    return rounded(
        df.selectExpr(
            "c_custkey",
            f"{repair('x', s['mean_nonzero'], s['max'], s['min'])} as repaired",
            f"coalesce({nan_to_null('x')}, -1.0D) > 1e300 as too_high",
        ),
        {"repaired": 6},
    )


# --- end to end --------------------------------------------------------------

def twin(
    spark, folder, name: str, in_levels, digits: int, key_cols=None, block=BLOCK, **options
) -> DataFrame:
    """A synthetic table with as many rows as the real one, per level."""
    source = table(spark, folder, name)
    model = fit_model(source, key_cols=key_cols, rng=RNG)
    made = generate(
        spark, model, source.count(), in_levels, rng=RNG, keep_id=True, block_rows=block, **options
    )
    return rounded(made, {c: digits for c in model.columns})


@query("generate_customer")
def generate_customer(spark, folder):
    return twin(spark, folder, "customer", [0.0], 3, ["c_custkey"])


@query("generate_customer_sweep")
def generate_customer_sweep(spark, folder):
    return twin(spark, folder, "customer", SWEEP, 3, ["c_custkey"])


@query("generate_customer_independent")
def generate_customer_independent(spark, folder):
    return twin(spark, folder, "customer", [0.1], 3, ["c_custkey"], copula=False)


@query("generate_orders")
def generate_orders(spark, folder):
    return twin(spark, folder, "orders", [0.1], 3, ["o_orderkey"])


@query("generate_lineitem")
def generate_lineitem(spark, folder):
    return twin(spark, folder, "lineitem", [0.0], 3, LINEITEM_KEY)


@query("generate_lineitem_fuzzed")
def generate_lineitem_fuzzed(spark, folder):
    return twin(spark, folder, "lineitem", [0.1], 3, LINEITEM_KEY, exact=True)


# a law that can be drawn from, whose quantile function is left unsaid
laws.register_family(
    "laplace", None, {"loc": "mean", "scale": "std * sqrt(0.5D)"},
    sampler=lambda uniform, p: f"{p['loc']} + {p['scale']} * (ln({uniform('a')}) - ln({uniform('b')}))",
)


@query("generate_sampled")
def generate_sampled(spark, folder):
    """Prices by a family that has a sampler only, read from one sorted sample for each level."""
    source = table(spark, folder, "orders")
    n = source.count()
    model = fit_model(source, ["o_totalprice"], families={"o_totalprice": "laplace"}, rng=RNG)
    made = generate(spark, model, n, [0.0, 0.1], rng=RNG, keep_id=True, block_rows=n, copula=False)
    return rounded(made, {"o_totalprice": 3})


def summary(made: DataFrame, groups: list[str], columns: list[str], digits: dict[str, int]) -> DataFrame:
    """Counts, means and deviations per group, for laws without a closed form."""
    measures = [F.count("*").alias("n_rows")]
    for c in columns:
        measures += [F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return rounded(
        made.groupBy(*groups).agg(*measures),
        {f"{m}_{c}": digits[c] for c in columns for m in ("avg", "std")},
    )


@query("generate_lineitem_summary")
def generate_lineitem_summary(spark, folder):
    """Fuzzed line items by tax rate; the discount's beta shape moves by block."""
    made = twin(spark, folder, "lineitem", [0.1], 12, LINEITEM_KEY, block=10_000)
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    return summary(made, ["l_tax"], columns, dict(zip(columns, (3, 5, 2, 6))))


def derived_rows(spark, folder, cols, block, exact=False) -> DataFrame:
    with Workspace(spark) as work:  # fitting reads the table four times, and each number of it is a hash
        source = work.keep(derived(spark, folder).select("o_orderkey", *cols))
        model, n = fit_model(source, cols, key_cols=["o_orderkey"], rng=RNG), source.count()
    return generate(spark, model, n, [0.0, 0.1], rng=RNG, keep_id=True, block_rows=block, exact=exact)


@query("generate_derived")
def generate_derived(spark, folder):
    """All derived columns; some depend on each other exactly, so the factor is repaired."""
    return rounded(derived_rows(spark, folder, DERIVED, BLOCK), {c: 6 for c in DERIVED})


SKEWED = ["frac", "expo", "lognorm", "erlang4", "heavy", "disc"]


@query("generate_derived_summary")
def generate_derived_summary(spark, folder):
    """One column of each skewed family, by category and level."""
    made = derived_rows(spark, folder, SKEWED, 1000)
    return summary(made, ["in_level", "disc"], SKEWED[:-1], dict.fromkeys(SKEWED, 3))


@query("generate_skewed")
def generate_skewed(spark, folder):
    """The same columns row by row: beta, gamma and chi-squared laws whose shapes move by block."""
    made = derived_rows(spark, folder, SKEWED, 1000, exact=True)
    return rounded(made, dict.fromkeys(SKEWED, 4))


laws.register_density(
    "logistic", lambda x: -np.abs(x) - 2.0 * np.log1p(np.exp(-np.abs(x))),
    {"loc": "mean", "scale": f"std * {double(3.0 ** 0.5 / np.pi)}"},
)


@query("generate_density")
def generate_density(spark, folder):
    """Prices by a family known by its density alone, fitted, moved by level, and drawn."""
    source = table(spark, folder, "orders")
    model = fit_model(source, ["o_totalprice"], families={"o_totalprice": "logistic"})
    made = generate(
        spark, model, source.count(), [0.0, 0.1], rng=RNG, keep_id=True, block_rows=BLOCK, copula=False)
    return rounded(made, {"o_totalprice": 1})


# --- run logs ----------------------------------------------------------------

def timed_runs(spark, folder) -> DataFrame:
    """A run log read out of the line items: sizes, two timings, some skipped."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_linenumber * 100000L as size",
        "l_quantity / 10 as spark_time",
        "if(l_linenumber > 5, null, l_extendedprice / 1000) as seq_time",
    )


@query("run_summary")
def run_summary(spark, folder):
    found = runs.run_summary(timed_runs(spark, folder)).drop("speedup")
    return rounded(found, {c: 6 for c in found.columns if c != "size"})


@query("speedup")
def speedup(spark, folder):
    found = runs.run_summary(timed_runs(spark, folder)).select("size", "speedup")
    return rounded(found, {"speedup": 6})


def two_phase_runs(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_linenumber * 100000L as size",
        "if(l_linenumber = 7, null, l_quantity / 10) as train_time",
        "if(l_linenumber > 5, null, l_extendedprice / 1000) as sample_time",
    )


@query("two_phase_summary")
def two_phase_summary(spark, folder):
    found = runs.two_phase_summary(two_phase_runs(spark, folder))
    return rounded(found, {c: 6 for c in found.columns if c != "size"})


@query("two_phase_presentation")
def two_phase_presentation(spark, folder):
    return runs.presentation(runs.two_phase_summary(two_phase_runs(spark, folder)))


@query("level_log")
def level_log(spark, folder):
    """Totals of a file log; each order stands for one file written."""
    log = table(spark, folder, "orders").selectExpr(
        "o_orderkey % 12 / 40 as in_level", "o_totalprice / 1000 as time",
        "concat('file_', o_orderkey) as filename",
    )
    return rounded(runs.level_log(log), {"total_time": 3, "average_time": 6})
