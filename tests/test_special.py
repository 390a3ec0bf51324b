"""Incomplete gamma and beta functions, and the exact quantiles made with them."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tabweave.functions import special
from tabweave.functions.text import ident
from tabweave.operators.draws import evaluate

PROBES = [1e-6, 1e-3, 0.05, 0.3, 0.5, 0.8, 0.999, 1 - 1e-6]


def poisson_tail(k, x):
    """Q(k, x) for a whole shape."""
    return math.fsum(math.exp(i * math.log(x) - x - math.lgamma(i + 1)) for i in range(int(k)))


def binomial_tail(a, b, x):
    n = a + b - 1
    return math.fsum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))


def test_log_gamma(spark):
    rows = spark.createDataFrame([(x,) for x in (1e-3, 0.3, 1.0, 2.5, 9.99, 10.0, 77.0, 1e6)], "k double")
    for r in rows.selectExpr("k", f"{special.log_gamma('k')} as g").collect():
        assert r.g == pytest.approx(math.lgamma(r.k), rel=1e-14, abs=1e-14)


def test_gamma_tails(spark):
    pairs = [(float(k), k * f) for k in (1, 2, 7, 40, 900, 20_000) for f in (0.6, 0.99, 1.0, 1.02, 1.5)]
    rows = spark.createDataFrame(pairs, "k double, x double").selectExpr(*special.gamma_cdf_parts("k", "x", "c"))
    low, high = special.gamma_tails("c_k", "c_t", "c_x", "c_w")
    for r in rows.selectExpr("*", f"{low} as p", f"{high} as q").collect():
        q = poisson_tail(r.c_k, r.c_x)
        assert r.p + r.q == pytest.approx(1.0, abs=1e-14) and r.q == pytest.approx(q, rel=1e-9, abs=1e-13)


def test_beta_cdf(spark):
    cells = [(float(a), float(b), x) for a in (1, 3, 60) for b in (1, 4, 200) for x in (1e-5, 0.02, 0.3, 0.5, 0.97)]
    rows = spark.createDataFrame(cells, "a double, b double, x double").selectExpr(
        *special.beta_cdf_parts("a", "b", "x", "c"))
    for r in rows.selectExpr("*", f"{special.beta_cdf('c')} as p").collect():
        assert r.p == pytest.approx(binomial_tail(int(r.c_a), int(r.c_b), r.c_x), rel=1e-10, abs=1e-14)


EXACT = {
    "gamma": ({"shape": 1.0, "scale": 2.5}, lambda u: -2.5 * math.log1p(-u), 1e-11),
    "chi2": ({"df": 2}, lambda u: -2 * math.log1p(-u), 1e-11),
    "beta": ({"a": 3.0, "b": 1.0, "loc": 0.0, "scale": 1.0}, lambda u: u ** (1 / 3), 1e-11),
}


@pytest.mark.parametrize("family", EXACT)
def test_exact_quantiles(spark, family):
    params, expected, tolerance = EXACT[family]
    probes = spark.createDataFrame([(p,) for p in PROBES], "p double")
    for r in evaluate(probes, "p", "x", family, params, exact=True).collect():
        assert r.x == pytest.approx(expected(r.p), rel=tolerance)


@pytest.mark.parametrize("shape", [0.1, 4.0, 300.0, 40_000.0])
def test_exact_gamma_inverts_its_cdf(spark, shape):
    probes = spark.createDataFrame([(p,) for p in PROBES], "p double")
    found = evaluate(probes, "p", "x", "gamma", {"shape": shape, "scale": 1.0}, exact=True)
    parts = special.gamma_cdf_parts(f"{shape}D", "x", "c")
    for r in found.selectExpr("p", *parts).selectExpr("p", f"{special.gamma_cdf('c')} as f").collect():
        assert r.f == pytest.approx(r.p, rel=1e-9)


def test_polish_keeps_columns_and_improves_a_rough_score(spark):
    """A score that is a per cent off comes back at the normal limit of a large shape."""
    z = NormalDist().inv_cdf(0.9)
    rows = spark.createDataFrame([(1, z, 1e6)], ["odd name", "z", "k"])
    out = special.polish(rows, [("gamma", "g", "z * 1.001D", "z", ["k"])])
    assert out.columns == ["odd name", "z", "k", "g_s"] and ident("odd name") == "`odd name`"
    assert out.first().g_s == pytest.approx(z, abs=2e-3)


def test_tails_of_arrays_are_those_of_the_expressions(spark):
    """Rows with different numbers of terms in one batch, on either side of the middle."""
    k, f = map(np.ravel, np.meshgrid([0.05, 1.0, 7.5, 40.0, 20_000.0], [0.2, 0.99, 1.02, 1.5]))
    rows = spark.createDataFrame(zip(k.tolist(), (k * f).tolist()), "k double, x double").coalesce(1).selectExpr(
        *special.gamma_cdf_parts("k", "x", "c"), *special.beta_cdf_parts("k", "2.5D", "x / (x + 3.0D)", "b"))
    tails = [*special.gamma_tails("c_k", "c_t", "c_x", "c_w"), *special.beta_tails(*(f"b_{p}" for p in "abxyw"))]
    got = rows.selectExpr("*", *(f"{t} as t{i}" for i, t in enumerate(tails))).toPandas()
    column = {c: got[c].to_numpy() for c in got}
    found = [*special.gamma_tails_array(*(column[f"c_{p}"] for p in "kxw")),
             *special.beta_tails_array(*(column[f"b_{p}"].astype(float) for p in "abxyw"))]
    for i, x in enumerate(found):
        assert x == pytest.approx(column[f"t{i}"], rel=1e-9, abs=1e-14)


def test_exact_scores_of_nulls_and_of_no_rows(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (None, 0.5), (2.0, -0.5)], "k double, z double")
    out = special.polish(rows, [("gamma", "g", "z", "z", ["k"])])
    assert [r.g_s is None for r in out.collect()] == [False, True, False]
    assert out.where("k > 5").collect() == []
    # the terms are summed over batches, not by an interpreted fold for each row
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
