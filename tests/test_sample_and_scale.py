"""Exact samples, ranks without a global sort, hot values, shared scratch, CSV."""

import os
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabweave import (
    Rng, bounded_sample, fit_model, generate, presentation, read_csv, read_sweep, two_phase_summary,
    write_level, write_sweep,
)
from tabweave.operators import dependence
from tabweave.operators.dependence import (
    normal_scores, normal_scores_at_scale, pairwise_correlation,
)
from tabweave.operators.sample import _numbered_copies
from tabweave.plans.files import write_levels
from tabweave.plans.runs import log_levels
from tabweave.sources import scratch


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(0, 50_000, 1, 4).withColumn("v", F.col("id") * 2)
    one = bounded_sample(df, 1000, ["id"])
    two = bounded_sample(df.repartition(9), 1000, ["id"])
    assert one.count() == 1000 and one.distinct().count() == 1000
    assert one.exceptAll(two).isEmpty()
    assert bounded_sample(df, 1000, ["id"], Rng(1)).exceptAll(one).count() > 900
    assert bounded_sample(df, 60_000, ["id"]).count() == 50_000


def test_sample_is_the_k_smallest(spark):
    df = spark.range(0, 5000)
    hashed = df.withColumn("u", F.expr(Rng().uniform("concat_ws('|', cast(id as string))", "sample")))
    want = {r["id"] for r in hashed.orderBy("u").limit(300).collect()}
    assert {r["id"] for r in bounded_sample(df, 300, ["id"]).collect()} == want


def test_sample_by_a_key_that_does_not_identify_rows(spark):
    """Rows of one key are drawn one by one, so all keys take part."""
    df = spark.range(0, 20_000, 1, 4).selectExpr("id", "id % 5 as key")
    sample = bounded_sample(df, 100, ["key"])
    assert sample.count() == 100 and sample.select("key").distinct().count() == 5


def test_sample_of_maps_and_of_random_columns(spark):
    maps = spark.range(0, 3000).selectExpr("id", "map('a', id % 7) as m")
    assert bounded_sample(maps, 500).count() == 500
    assert fit_model(maps, sample_limit=500).columns == ["id"]
    drawn = bounded_sample(spark.range(0, 5000, 1, 3).selectExpr("id", "rand(3) as r"), 400, ["id"])
    assert drawn.count() == 400 and drawn.exceptAll(drawn).isEmpty()


@pytest.mark.parametrize("few", [1, 40])
def test_half_the_table_is_found_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr("tabweave.operators.sample.SORTED_ROWS", few)
    df = spark.range(0, 20_000, 1, 5).selectExpr("id", "id % 7 as v")
    hashes = df.selectExpr("id", f"{Rng().uniform('cast(id as string)', 'sample')} as u").collect()
    want = {r["id"] for r in sorted(hashes, key=lambda r: r["u"])[:10_000]}
    half = bounded_sample(df, 10_000, ["id"])
    assert {r["id"] for r in half.collect()} == want and half.count() == 10_000
    plan = half._jdf.queryExecution().executedPlan().toString()
    limit = int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert limit <= few and "Exchange" not in plan  # only the last few rows are sorted
    assert bounded_sample(df, 0, ["id"]).count() == 0 and bounded_sample(df, 19_999, ["id"]).count() == 19_999
    repeated = df.selectExpr("v")  # seven different rows
    counts = {r["v"]: r["count"] for r in bounded_sample(repeated, 10_000).groupBy("v").count().collect()}
    assert sum(counts.values()) == 10_000 and all(c == pytest.approx(1430, abs=150) for c in counts.values())



def test_sample_of_repeated_rows(spark):
    """A third of all rows are equal: they are drawn one by one."""
    df = spark.range(0, 30_000).selectExpr("if(id < 10000, 0, id) as x")
    sample = bounded_sample(df, 3000)
    assert sample.count() == 3000
    assert sample.where("x = 0").count() == pytest.approx(1000, abs=150)


def test_copies_are_numbered_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("tabweave.operators.sample.COPIES_PER_TASK", 7)
    df = spark.createDataFrame([(1,)] * 23 + [(2,)], "x int")
    found = sorted((r["x"], r["__copy"]) for r in _numbered_copies(df).collect())
    assert found == [(1, i) for i in range(23)] + [(2, 0)]


def test_scores_at_scale_match_the_bounded_ones(spark):
    """With ties, nulls, and a value on a third of all rows."""
    df = spark.range(0, 6000, 1, 5).selectExpr(
        "id", "if(id % 3 = 0, 7.0, rand(1)) as hot", "round(100 * rand(2)) as ties",
        "if(id % 10 = 0, null, rand(3) + id / 6000) as gaps",
    ).persist()
    cols = ["hot", "ties", "gaps"]
    a = {(r[0], r[1]): r[2] for r in pairwise_correlation(normal_scores(df, cols), cols).collect()}
    b = {
        (r[0], r[1]): r[2]
        for r in pairwise_correlation(normal_scores_at_scale(df, cols), cols).collect()
    }
    c = {
        (r[0], r[1]): r[2]
        for r in pairwise_correlation(normal_scores_at_scale(df, cols), cols).collect()
    }
    assert a.keys() == b.keys() == c.keys() and len(a) == 3
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert all(a[k] == pytest.approx(c[k], abs=1e-12) for k in a)
    df.unpersist()


@pytest.mark.parametrize("lookup, block", [(0, 300), (0, 10**6), (150, 300), (10**6, 300)])
def test_indexed_and_dealt_columns_agree(spark, lookup, block):
    """Columns that tasks look up, and columns whose cells move, with hot values, ties and gaps."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 4000
    frame = {
        "few": rng.integers(0, 7, n).astype(float), "zeros": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)),
        "odd.name": rng.normal(size=n), "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 900, n) / 7),
        "none": np.full(n, np.nan), "one": np.full(n, 3.0), "ends": np.where(rng.random(n) < 0.1, np.inf, rng.random(n)),
    }
    cols = list(frame)
    rows = [(i, *(float(frame[c][i]) for c in cols)) for i in range(n)]
    df = spark.createDataFrame(rows, ["k", *cols]).repartition(5).withColumn("twin", F.col("k"))
    got = normal_scores_at_scale(df, [*cols, "twin"], lookup_values=lookup, block_cells=block).collect()
    assert len(got) == n
    at = sorted(range(n), key=lambda r: got[r]["twin"])  # the scores of k tell the rows apart
    for c in cols:
        ranks = pd.Series(frame[c]).rank(method="average")
        want = [None if r != r else NormalDist().inv_cdf((r - 0.5) / ranks.count()) for r in ranks]
        have = [got[i][c] for i in at]
        assert [h is None for h in have] == [w is None for w in want]
        assert [h for h in have if h is not None] == pytest.approx([w for w in want if w is not None], abs=1e-12)


def test_indexed_columns_do_not_move(spark):
    df = spark.range(1000).selectExpr("id % 7 as a", "id % 50 as b", "rand(1) as c")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(normal_scores_at_scale(df, ["a", "b"]))
    assert plan(normal_scores_at_scale(df, ["a", "b", "c"], lookup_values=100)).count("Exchange") == 3
    assert normal_scores_at_scale(df.limit(0), ["a", "c"], lookup_values=0).count() == 0


def test_scores_by_brute_force(spark):
    pandas = pytest.importorskip("pandas")
    from statistics import NormalDist

    values = [5.0, 1.0, 5.0, 2.0, 9.0, 5.0, 1.0]
    df = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(values)], "k int, x double, y double")
    ranks = pandas.Series(values).rank(method="average")
    want = sorted(NormalDist().inv_cdf((r - 0.5) / len(values)) for r in ranks)
    for scores in (normal_scores(df, ["x", "y"]), normal_scores_at_scale(df, ["x", "y"])):
        assert sorted(r["x"] for r in scores.collect()) == pytest.approx(want)


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_freeze_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        scratch.freeze(spark.range(11), 10)


def test_sweep_to_csv_and_back(spark, tmp_path):
    model = fit_model(spark.range(1, 200).selectExpr("double(id) as x", "id % 3 as k"))
    made = generate(spark, model, 100, [0.0, 0.075], num_partitions=4)
    folder = str(tmp_path / "sweep")
    write_sweep(made, folder)
    assert {d for d in os.listdir(folder) if "=" in d} == {"in_level=0.000", "in_level=0.075"}
    back = read_sweep(spark, folder, "x double, k double, in_level double")
    assert back.exceptAll(made.select("x", "k", "in_level")).isEmpty() and back.count() == 200


def test_level_files(spark, tmp_path):
    model = fit_model(spark.range(1, 200).selectExpr("double(id) as x", "cast(id % 3 as int) as k"))
    made = generate(spark, model, 50, [0.1])
    path = write_level(made, str(tmp_path), 0.1, 50)
    assert os.path.basename(path) == "synthetic_IN_0.100_size_50.csv"
    back = read_csv(spark, path)
    assert dict(back.dtypes) == {"x": "double", "k": "double"} and back.count() == 50
    with pytest.raises(Exception):
        write_level(made, str(tmp_path), 0.1, 50)


def test_close_levels_stay_apart(spark, tmp_path):
    model = fit_model(spark.range(1, 200).selectExpr("double(id) as x"))
    folder = str(tmp_path / "close")
    write_sweep(generate(spark, model, 100, [0.1001, 0.1004, 0.1]), folder)
    counts = read_sweep(spark, folder).groupBy("in_level").count().collect()
    assert {r["in_level"]: r["count"] for r in counts} == {0.1001: 100, 0.1004: 100, 0.1: 100}
    log = log_levels(write_levels(spark, model, 30, [0.1001, 0.1004], str(tmp_path / "files"))).collect()
    assert {r["filename"] for r in log} == {
        "synthetic_IN_0.1001_size_30.csv", "synthetic_IN_0.1004_size_30.csv"}
    assert all(r["files"] == 1 and r["total_time"] > 0 for r in log)


def test_csv_types_are_inferred(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b,c\n1,2.5,x\n,3.5,y\n3,,z\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string"}
    assert fit_model(df).columns == ["a", "b"]


def test_presentation(spark):
    runs = spark.createDataFrame(
        [(1, 100000, 10.0, 1.0), (2, 100000, 12.0, 2.0), (1, 5000000, 10.0, None), (1, 7, None, 1.0)],
        "run int, size long, train_time double, sample_time double",
    )
    shown = {r[0]: tuple(r)[1:] for r in presentation(two_phase_summary(runs)).collect()}
    assert shown["100,000"] == ("11.00 ± 1.41", "1.50 ± 0.71", "12.50 ± 1.58")
    assert shown["5,000,000"] == ("10.00 ± nan", "N/A (OOM)", "N/A (OOM)")
    assert shown["7"] == ("N/A", "1.00 ± nan", "N/A (OOM)")


def test_no_task_deals_or_answers_more_than_half_a_million_cells():
    """Four workers of an executor hold such a group each, several times over."""
    assert dependence.DEALT_CELLS <= 500_000 and dependence.ANSWER_CELLS <= 500_000
