"""Generated tables: repeatability, laws, clips, levels and plans."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave import Rng, fit_model, generate, register_family
from tabweave.operators.frequencies import draw_category
from tabweave.sources.scratch import Workspace
from tabweave.operators.dependence import correlation_factor
from tabweave.operators.draws import draw
from tabweave.operators.laws import FAMILIES
from tabweave.sources.scratch import shared_folder
from tabweave.workload import queries as workload

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(0, 20_000, 1, 4).selectExpr(
        "id",
        "rand(1) as unit",
        "-50 * ln(rand(2)) as long_tail",
        "-ln(rand(3)) - ln(rand(4)) - ln(rand(5)) - ln(rand(6)) as erlang",
        "10 * exp(0.4 * randn(7)) as logn",
        "if(rand(8) < 0.3, 0, 5 + 2 * rand(9)) as zeros",
        "cast(floor(4 * rand(10)) as int) as kind",
    ).persist()


@pytest.fixture(scope="module")
def model(source):
    return fit_model(source.drop("id"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("levels", [[0.0], [0.2], [0.0, 0.1]])
def test_partitions_do_not_matter(spark, model, levels):
    one, seven, many = (
        generate(spark, model, 3000, levels, num_partitions=p, keep_id=True) for p in (1, 7, 200)
    )
    assert same(one, seven) and same(one, many)
    assert one.count() == 3000 * len(levels)


def test_block_size_matters_only_with_indeterminacy(spark, model):
    assert same(generate(spark, model, 2000, block_rows=10), generate(spark, model, 2000, block_rows=999))
    assert not same(
        generate(spark, model, 2000, [0.2], block_rows=10),
        generate(spark, model, 2000, [0.2], block_rows=999),
    )


def test_seed_matters(spark, model):
    assert not same(generate(spark, model, 500), generate(spark, model, 500, rng=Rng(43)))


def test_ids_of_a_table(spark, model):
    ids = spark.range(0, 1500, 1, 3)
    made = generate(spark, model, ids=ids, in_levels=[0.0, 0.1], block_rows=8, keep_id=True)
    assert same(made, generate(spark, model, 1500, [0.0, 0.1], block_rows=8, keep_id=True))


def test_levels_are_one_job_of_separate_rows(spark, model):
    made = generate(spark, model, 1000, [0.0, 0.3])
    assert {r["in_level"]: r["count"] for r in made.groupBy("in_level").count().collect()} == {
        0.0: 1000, 0.3: 1000
    }
    alone = generate(spark, model, 1000, [0.3])
    assert same(made.where("in_level = 0.3").drop("in_level"), alone)


def test_columns_follow_their_laws(spark, source, model):
    families = {c: f for c, (f, _) in model.law_of.items()}
    assert families == {
        "unit": "beta", "long_tail": "exponential", "erlang": "gamma", "logn": "lognormal",
        "zeros": families["zeros"],
    }
    made = generate(spark, model, 60_000).persist()
    real = source.agg(F.avg("erlang"), F.stddev("erlang"), F.avg("long_tail")).first()
    got = made.agg(F.avg("erlang"), F.stddev("erlang"), F.avg("long_tail"), F.avg("unit")).first()
    assert got[0] == pytest.approx(real[0], rel=0.01) and got[1] == pytest.approx(real[1], rel=0.02)
    assert got[2] == pytest.approx(real[2], rel=0.02) and got[3] == pytest.approx(0.5, abs=0.01)
    zero = made.agg(F.avg((F.col("zeros") == 0).cast("int"))).first()[0]
    assert zero == pytest.approx(model.statistics["zeros"]["zero_ratio"], abs=0.01)
    shares = {r["kind"]: r["count"] / 60_000 for r in made.groupBy("kind").count().collect()}
    assert set(shares) == {0.0, 1.0, 2.0, 3.0} and all(abs(s - 0.25) < 0.02 for s in shares.values())
    made.unpersist()


def test_correlation_is_reproduced(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("randn(1) as a", "randn(2) as b").selectExpr(
        "a + 10 as x", "0.8 * a + 0.6 * b + 10 as y", "10 - b as z"
    )
    model = fit_model(df)
    made = generate(spark, model, 60_000)
    want = df.agg(F.corr("x", "y"), F.corr("y", "z"), F.corr("x", "z")).first()
    got = made.agg(F.corr("x", "y"), F.corr("y", "z"), F.corr("x", "z")).first()
    assert all(abs(a - b) < 0.04 for a, b in zip(want, got))
    alone = generate(spark, model, 60_000, copula=False).agg(F.corr("x", "y")).first()[0]
    assert abs(alone) < 0.02


def test_one_factor_per_block(spark):
    """With a uniform law the factor of a block can be read off its values."""
    df = spark.range(1, 1001).selectExpr("double(id) as x")
    model = fit_model(df)
    level, size = 0.25, 50
    made = generate(spark, model, 1000, [level], block_rows=size, keep_id=True)
    plain = generate(spark, model, 1000, [0.0], block_rows=size, keep_id=True)
    ratio = (
        made.withColumnRenamed("x", "moved").join(plain, "id")
        .where("moved > 0.9 and moved < 1100 and x < 1000")
        .selectExpr(f"id div {size} as block", "moved / x as g")
        .groupBy("block").agg(F.min("g"), F.max("g")).collect()
    )
    assert len(ratio) == 20
    for _, low, high in ratio:
        assert low == pytest.approx(high, rel=1e-9) and 1 - level <= low <= 1 + level
    assert len({round(low, 9) for _, low, _ in ratio}) == 20


@pytest.mark.parametrize("fuzz", ["shared", "independent"])
def test_all_families_stay_in_range(spark, model, fuzz):
    made = generate(spark, model, 20_000, [0.0, 0.1, 0.3], fuzz=fuzz)
    for c in model.columns:
        s = model.statistics[c]
        low, high, bad = made.agg(
            F.min(c), F.max(c), F.sum(F.expr(f"int({c} is null or isnan({c}))"))
        ).first()
        assert bad == 0 and low >= min(0.0, s["min"] * 0.9) and high <= s["max"] * 1.1


def test_column_without_a_law_falls_back_to_a_normal(spark):
    df = spark.range(1, 1001).selectExpr("double(id) as x")
    model = fit_model(df)
    model.laws = model.laws.where("false")
    got = generate(spark, model, 50_000, [0.1]).agg(F.avg("x"), F.stddev("x")).first()
    assert got[0] == pytest.approx(500.5, rel=0.02)
    # the factors add variance of their own
    assert got[1] == pytest.approx(math.hypot(288.7, 500.5 * 0.1 / math.sqrt(3)), rel=0.03)


def test_wide_models_give_the_same_values(spark, model, monkeypatch):
    """The matrix product in batches, used for many columns, against literal weights."""
    few = generate(spark, model, 3000, [0.0, 0.2], keep_id=True)
    monkeypatch.setattr("tabweave.plans.generate.LITERAL_COLUMNS", 1)
    assert same(few, generate(spark, model, 3000, [0.0, 0.2], keep_id=True))


def test_generation_neither_shuffles_nor_runs_python(spark, model):
    for levels in ([0.0], [0.0, 0.1]):
        plan = generate(spark, model, 1000, levels)._jdf.queryExecution().executedPlan().toString()
        for operator in ("Exchange", "Join", "Python", "Window", "Sort"):
            assert operator not in plan


def test_bad_arguments(spark, model):
    for bad in ([1.0], [-0.1], [], [0.1, 0.1]):
        with pytest.raises(ValueError):
            generate(spark, model, 10, bad)
    with pytest.raises(ValueError):
        generate(spark, model)
    with pytest.raises(ValueError):
        generate(spark, model, 10, fuzz="other")


def test_factor_of_an_impossible_correlation():
    rho = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    lower = correlation_factor(rho)
    assert np.allclose(np.diag(lower @ lower.T), 1.0)
    undefined = np.array([[1.0, np.nan], [np.nan, 1.0]])
    assert np.allclose(correlation_factor(undefined), np.eye(2))


def test_first_rows_do_not_depend_on_the_number_of_rows(spark, model):
    few = generate(spark, model, 1000, [0.1], keep_id=True)
    many = generate(spark, model, 40_000, [0.1], keep_id=True)
    ids = generate(spark, model, ids=spark.range(1000), in_levels=[0.1], keep_id=True)
    assert same(few, many.where("id < 1000")) and same(few, ids)


def test_a_large_table_is_fitted_whole(spark):
    """More than 100000 rows, with one row of a rare category and one extreme value."""
    df = spark.range(0, 200_000, 1, 4).selectExpr(
        "if(id = 77, 2, int(id % 2)) as kind", "if(id = 99, 1e6, 5 + rand(1)) as x", "rand(2) * 10 as y"
    ).persist()
    model = fit_model(df)
    shares = {r["value"]: r["p"] for r in model.frequencies.collect()}
    assert set(shares) == {0.0, 1.0, 2.0} and shares[2.0] == 1 / 200_000
    assert model.statistics["x"]["max"] == 1e6
    assert all(s["unique_count"] for s in model.statistics.values())
    want = df.select(F.percent_rank().over(Window.orderBy("x")).alias("a"), "y").agg(F.corr("a", "y")).first()[0]
    assert model.correlation.first()["rho"] == pytest.approx(want, abs=0.01)
    work = shared_folder(spark)
    assert not [f for f in os.listdir(work) if f.startswith("work-")]
    df.unpersist()


def test_named_and_registered_families(spark):
    df = spark.range(1, 4001).selectExpr("double(id) / 4 as x", "id % 7 as few", "id * 1.5D as y")
    model = fit_model(df, families={"x": "weibull", "few": "gamma"})
    assert {c: f for c, (f, _) in model.law_of.items()} == {"x": "weibull", "few": "gamma", "y": "uniform"}
    assert model.law_of["x"][1]["scale"] == pytest.approx(500.125)
    made = generate(spark, model, 40_000).agg(F.avg("x"), F.max("few")).first()
    scale, gamma = 500.125, math.gamma(1 + 1 / 1.5)
    assert made[0] == pytest.approx(scale * gamma, rel=0.02) and made[1] <= 6 * 1.1
    with pytest.raises(ValueError):
        fit_model(df, families={"x": "nothing"})
    register_family("twice", lambda draw, p: f"{p['scale']} * {draw.u}", {"scale": "2 * mean"})
    try:
        again = fit_model(df, families={"x": "twice"})
        assert generate(spark, again, 40_000).agg(F.avg("x")).first()[0] == pytest.approx(500, rel=0.02)
    finally:
        FAMILIES.pop("twice")


def test_many_categories(spark):
    """The array form gives what a search among the running shares gives, however they are spread."""
    import numpy as np

    rng = np.random.default_rng(8)
    for n, power in ((33, 0), (1000, 3), (10_000, 12)):
        weights = rng.random(n) ** power + 1e-12
        cum = np.cumsum(weights / weights.sum())
        points = np.concatenate([[1e-16, 1 - 2.0 ** -53], cum[:-1], np.arange(1, n) / n, rng.random(2000)])
        rows = spark.createDataFrame([(float(u),) for u in points if 0 < u < 1], "u double")
        expression = draw_category("u", list(zip((np.arange(n) * 2.0).tolist(), cum.tolist())))
        found = rows.selectExpr("u", f"{expression} as x").toPandas()
        assert (found.x == 2.0 * np.searchsorted(cum[:-1], found.u, "right")).all()


def test_table_with_many_categories(spark):
    """174 categories from the fit to the rows: the smoothed shares, and no shuffle."""
    df = spark.range(30_000).selectExpr("double(floor(sqrt(id % 40000))) as x", "id * 0.5D as y")
    model = fit_model(df, discrete_max=10_000)
    made = generate(spark, model, 60_000)
    assert list(model.categories) == ["x"] and len(model.categories["x"]) == 174
    assert made.select("x").distinct().count() > 165
    below, mean = 0.0, 0.0
    for value, cum in model.categories["x"]:  # smoothed shares
        below, mean = cum, mean + value * (cum - below)
    assert made.agg(F.avg("x")).first()[0] == pytest.approx(mean, rel=0.01)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_family_with_a_sampler_only(spark):
    """Sums of three uniforms, through the fit, the copula and blocks; scratch tables go at the end."""
    register_family(
        "three", None, {"loc": "min", "scale": "max - min"},
        sampler=lambda u, p: f"{p['loc']} + {p['scale']} * ({u('a')} + {u('b')} + {u('c')}) / 3.0D")
    try:
        df = spark.range(1, 4001).selectExpr("double(id) / 4 as x", "id * 1.5D as y", "sqrt(id) as v")
        model = fit_model(df, families={"x": "three", "v": "three"})
        with Workspace(spark) as work:
            made = generate(spark, model, 30_000, [0.0, 0.2], keep_id=True, block_rows=7000, keep=work.keep)
            rows = made.toPandas()
            other = generate(spark, model, ids=spark.range(30_000), in_levels=[0.0, 0.2], keep_id=True,
                             block_rows=7000, num_partitions=3, keep=work.keep).toPandas()
            path = spark._jvm.org.apache.hadoop.fs.Path(work.folder)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            assert files.exists(path)
        assert not files.exists(path)
        key = ["in_level", "id"]
        rows, other = (t.sort_values(key).reset_index(drop=True) for t in (rows, other))
        assert rows.equals(other) and len(rows) == 60_000 and not rows.isna().any().any()
        plain = rows[rows.in_level == 0.0]
        assert plain.x.mean() == pytest.approx(500, rel=0.01)
        assert plain.x.std() == pytest.approx(999.75 / 6, rel=0.02)  # sqrt(3 / 12) / 3 of the range
        assert plain[["x", "y", "v"]].corr(method="spearman").min().min() > 0.99
    finally:
        FAMILIES.pop("three")
    with pytest.raises(ValueError):
        register_family("both", lambda d, p: "0D", {"loc": "min"}, sampler=lambda u, p: "0D")
    with pytest.raises(ValueError):
        register_family("neither", None, {"loc": "min"})


def test_degrees_of_freedom_beyond_an_int(spark):
    """Epochs in milliseconds: chi-squared with 1.7e12 degrees of freedom."""
    df = spark.range(2000).selectExpr("1.7e12 + 1e6 * id as x")
    model = fit_model(df, families={"x": "chi2"})
    assert model.laws.first()["p_df"] == int(1.7e12 + 1e6 * 999.5)
    for level in (0.0, 0.1):
        made = generate(spark, model, 4000, [level]).agg(F.avg("x"), F.stddev("x"), F.count("x")).first()
        assert made[0] == pytest.approx(1.7e12, rel=0.05) and made[2] == 4000
    free = draw(spark.range(20_000), "id", "v", "chi2", {"df": 5_000_000_000})
    mean, std = free.agg(F.avg("v"), F.stddev("v")).first()
    assert mean == pytest.approx(5e9, rel=1e-5) and std == pytest.approx(1e5, rel=0.03)


def test_model_of_a_sampled_table(spark):
    """If asked for, the laws come from a sample; the profile stays whole."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    whole = fit_model(orders)
    part = fit_model(orders, sample_limit=4000, key_cols=["o_orderkey"])
    again = fit_model(orders.repartition(5), sample_limit=4000, key_cols=["o_orderkey"])
    assert part.law_of.keys() == whole.law_of.keys()
    assert part.law_of["o_totalprice"][0] == whole.law_of["o_totalprice"][0] == "uniform"
    assert part.statistics["o_totalprice"]["max"] == whole.statistics["o_totalprice"]["max"]
    assert part.law_of["o_totalprice"][1]["loc"] == again.law_of["o_totalprice"][1]["loc"]
    assert part.law_of["o_totalprice"][1]["loc"] >= whole.law_of["o_totalprice"][1]["loc"]


def test_derived_rows_are_made_once_and_removed(spark, tmp_path, monkeypatch):
    """Fitting reads what was written, not the hashes again."""
    seen = []
    fit = workload.fit_model

    def fitted(source, *args, **options):
        seen.append(source.inputFiles())
        return fit(source, *args, **options)

    monkeypatch.setattr(workload, "fit_model", fitted)
    spark.range(400).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    rows = workload.derived_rows(spark, str(tmp_path), ["expo", "gauss"], 100)
    assert seen[0] and all("/work-" in f for f in seen[0])
    assert rows.count() == 800 and not any(os.path.exists(f.removeprefix("file://")) for f in seen[0])
