"""Edge tables of the profile, the laws and the model."""

import math

import pytest

from tabweave import fit_family, fit_model, generate, numeric_columns, profile, register_family
from tabweave.operators.laws import FAMILIES, choose_laws, moments
from tabweave.operators.profile import column_roles


def rows_of(df):
    return {r["col_name"]: r for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    row = profile(df).first()
    assert row["n_rows"] == 0 and row["unique_count"] == 0 and row["is_binary"]
    assert row["mean"] == 0.0 and row["min"] is None and row["zero_ratio"] is None
    assert generate(spark, fit_model(df), 3).collect() == [(None,)] * 3


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("a",)], "s string")
    assert numeric_columns(df) == [] and profile(df).count() == 0
    assert fit_model(df).columns == []


def test_constant_and_single_row(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    row = profile(df).first()
    assert (row["std"], row["skewness"], row["kurtosis"], row["unique_count"]) == (0, 0, 0, 1)
    model = fit_model(df)
    assert [tuple(r) for r in model.frequencies.collect()] == [("x", 5.0, 1.0)]
    assert {r["x"] for r in generate(spark, model, 50, [0.3]).collect()} == {5.0}
    single = profile(spark.createDataFrame([(2.0,)], "x double")).first()
    assert (single["mean"], single["std"], single["skewness"]) == (2.0, 0.0, 0.0)


def test_all_null_and_all_negative(spark):
    df = spark.createDataFrame([(None, float(-i)) for i in range(1, 21)], "n double, x double")
    found = rows_of(profile(df))
    assert found["n"]["unique_count"] == 0 and found["n"]["is_binary"]
    assert found["x"]["mean_nonzero"] == found["x"]["mean"] == -10.5
    assert found["x"]["std_nonzero"] == found["x"]["std"]
    model = fit_model(df)
    law = model.laws.first()
    assert (law["family"], law["p_loc"]) == ("normal", -10.5)
    made = generate(spark, model, 500, [0.1]).collect()
    # both bounds of the range clip are shares of negative numbers
    assert all(r["n"] is None and -18.0 <= r["x"] <= -1.1 for r in made)


def test_nan_is_missing_and_nulls_count_as_rows(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (2.0,), (4.0,)], "x double")
    row = profile(df).first()
    assert (row["mean"], row["unique_count"], row["zero_ratio"]) == (2.0, 3, 0.2)
    assert row["mean_nonzero"] == 3.0 and row["std_nonzero"] == 1.0


def test_narrow_types_are_ignored_unless_asked_for(spark):
    df = spark.range(5).selectExpr(
        "cast(id as tinyint) b", "cast(id as smallint) h", "cast(id as decimal(5,2)) d",
        "cast(id as int) i", "cast(id as float) f", "cast(id as string) s",
    )
    assert numeric_columns(df) == ["i", "f"]
    assert numeric_columns(df, "all") == ["b", "h", "d", "i", "f"]
    assert [role for _, _, role in column_roles(df)] == ["ignored"] * 3 + ["numeric"] * 2 + ["ignored"]
    assert rows_of(profile(df, numeric_types="all"))["d"]["mean"] == 2.0


def test_odd_column_names(spark):
    df = spark.range(100).selectExpr("id as `a.b`", "id * 2 as `it's a `` name`")
    model = fit_model(df)
    made = generate(spark, model, 10, [0.1])
    assert made.columns == df.columns and made.count() == 10


def test_large_ids_stay_distinct(spark):
    df = spark.range(50).selectExpr("9007199254740992L + id as x")
    assert profile(df).first()["unique_count"] == 50


def test_flags_are_exact_without_counting(spark):
    # sorted so that the first rows show a single value of a many-valued column
    df = spark.range(0, 5000, 1, 4).selectExpr(
        "id as many", "id % 3 as few", "if(id < 4000, 0, id) as late"
    )
    exact, near = rows_of(profile(df)), rows_of(profile(df, distinct="approximate"))
    for c in ("many", "few", "late"):
        assert near[c]["is_binary"] == exact[c]["is_binary"]
        assert near[c]["unique_count"] == pytest.approx(exact[c]["unique_count"], rel=0.2)
    assert near["few"]["unique_count"] == 3


def test_bias_corrected_moments(spark):
    pandas = pytest.importorskip("pandas")
    values = [float(i**2 % 37) for i in range(1, 60)]
    row = profile(spark.createDataFrame([(v,) for v in values], "x double"), bias="sample").first()
    series = pandas.Series(values)
    assert row["skewness"] == pytest.approx(series.skew())
    assert row["kurtosis"] == pytest.approx(series.kurtosis())
    assert row["std_nonzero"] == pytest.approx(series[series > 0].std())


OUTCOMES = {
    # name: (skewness, excess kurtosis, n, max of the positives) -> family
    "few": (0.0, 0.0, 9, 50.0, "normal"),
    "unit": (0.0, 0.0, 100, 1.0, "beta"),
    "long": (2.1, 0.0, 100, 50.0, "exponential"),
    "peaked": (1.0, 3.1, 100, 50.0, "lognormal"),
    "skewed": (1.0, 3.0, 100, 50.0, "gamma"),
    "bell": (0.1, 3.5, 100, 50.0, "normal"),
    "flat": (0.1, 0.0, 100, 50.0, "uniform"),
    "heavy": (0.1, 5.5, 100, 50.0, "chi2"),
    "other": (0.1, 1.8, 100, 50.0, "normal"),
    "left": (-1.0, 4.5, 100, 50.0, "normal"),
}


def test_every_branch_of_the_choice(spark):
    stats = spark.createDataFrame(
        [(i, c, 3.0, 4.0, s, k, False) for i, (c, (s, k, *_)) in enumerate(OUTCOMES.items())],
        "position int, col_name string, mean_nonzero double, std_nonzero double,"
        " skewness double, kurtosis double, is_binary boolean",
    )
    positives = spark.createDataFrame(
        [(c, n, 10.0, 5.0, 0.5, top) for c, (_, _, n, top, _) in OUTCOMES.items()],
        "col_name string, n bigint, mean double, std double, min double, max double",
    )
    found = rows_of(choose_laws(stats, positives))
    assert {c: found[c]["family"] for c in found} == {c: o[-1] for c, o in OUTCOMES.items()}
    assert (found["few"]["p_loc"], found["few"]["p_scale"]) == (3.0, 4.0)
    assert (found["peaked"]["p_s"], found["peaked"]["p_scale"]) == (0.5, 10.0)
    assert (found["skewed"]["p_shape"], found["skewed"]["p_scale"]) == (4.0, 2.5)
    assert found["heavy"]["p_df"] == 10
    raw = rows_of(choose_laws(stats, positives, kurtosis="raw"))
    assert raw["flat"]["family"] == "normal" and raw["skewed"]["family"] == "lognormal"


def test_degenerate_gamma_is_repaired(spark):
    """Equal positives next to negatives: the shape is undefined."""
    df = spark.createDataFrame(
        [(float(-i % 15) * -0.01,) for i in range(15)] + [(9.0,)] * 12, "x double"
    )
    model = fit_model(df)
    made = generate(spark, model, 200, [0.2]).collect()
    assert all(r["x"] is not None and math.isfinite(r["x"]) for r in made)


def test_registered_family(spark):
    register_family(
        "gumbel", lambda draw, p: f"{p['loc']} - {p['scale']} * ln(-ln({draw.u}))",
        {"loc": "mean - 0.5772156649015329 * std * 0.7796968012336761",
         "scale": "std * 0.7796968012336761"},
    )
    try:
        df = spark.range(1000).selectExpr("double(id) as x")
        laws = fit_family(df, ["x"], "gumbel").drop("position")
        model = fit_model(df)
        model.laws = laws
        made = generate(spark, model, 20_000).agg({"x": "avg"}).first()[0]
        assert made == pytest.approx(499.5, abs=15)
        with pytest.raises(ValueError):
            register_family("bad", lambda d, p: "0D", {"theta": "mean"})
    finally:
        FAMILIES.pop("gumbel", None)


def test_positive_moments_ignore_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (-1.0,), (1.0,), (3.0,)], "x double")
    row = moments(df, ["x"], positive_only=True).first()
    assert (row["n"], row["mean"], row["std"], row["min"], row["max"]) == (2, 2.0, 1.0, 1.0, 3.0)
