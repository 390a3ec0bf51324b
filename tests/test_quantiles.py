"""Quantile functions against closed forms and numerical inversion."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tabweave.functions.normal import normal_cdf, normal_quantile, quantile_parts
from tabweave.functions.scores import ScorePolynomial, curve, z_limit
from tabweave.operators.draws import draw, empirical_quantile, evaluate, read_sorted

import numpy as np

PROBES = [1e-6, 1e-3, 0.05, 0.3, 0.5, 0.8, 0.999, 1 - 1e-6]


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame([(p,) for p in PROBES], "p double")


def values(probes, family, params):
    rows = evaluate(probes, "p", "x", family, params).collect()
    return {r["p"]: r["x"] for r in rows}


def test_normal_quantile_is_exact(probes):
    rows = probes.selectExpr("p", *quantile_parts("p", "n")).selectExpr(
        "p", f"{normal_quantile('n')} as z"
    ).collect()
    for r in rows:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-14, abs=1e-15)


def test_normal_cdf(spark):
    rows = spark.range(-60, 61).selectExpr("id / 10D as z").selectExpr(
        "z", f"{normal_cdf('z')} as p"
    ).collect()
    for r in rows:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=1e-14)


CLOSED = {
    "normal": ({"loc": 3.0, "scale": 2.0}, lambda u: 3 + 2 * NormalDist().inv_cdf(u)),
    "lognormal": ({"s": 0.5, "scale": 7.0}, lambda u: 7 * math.exp(0.5 * NormalDist().inv_cdf(u))),
    "exponential": ({"scale": 4.0}, lambda u: -4 * math.log1p(-u)),
    "weibull": ({"c": 1.5, "scale": 4.0}, lambda u: 4 * (-math.log1p(-u)) ** (1 / 1.5)),
    "uniform": ({"loc": -1.0, "scale": 5.0}, lambda u: -1 + 5 * u),
    "beta": (
        {"a": 2.0, "b": 2.0, "loc": 1.0, "scale": 3.0},
        lambda u: 1 + 3 * (0.5 - math.sin(math.asin(1 - 2 * u) / 3)),
    ),
    "gamma": ({"shape": 1.0, "scale": 2.5}, lambda u: -2.5 * math.log1p(-u)),
    "chi2": ({"df": 2}, lambda u: -2 * math.log1p(-u)),
}


@pytest.mark.parametrize("family", CLOSED)
def test_closed_forms(probes, family):
    params, expected = CLOSED[family]
    for u, x in values(probes, family, params).items():
        assert x == pytest.approx(expected(u), rel=5e-6, abs=1e-9)


def test_gamma_of_whole_shape_inverts_its_cdf(probes):
    for u, x in values(probes, "gamma", {"shape": 4.0, "scale": 1.0}).items():
        cdf = 1 - math.exp(-x) * sum(x**i / math.factorial(i) for i in range(4))
        assert cdf == pytest.approx(u, rel=2e-5, abs=1e-11)


@pytest.mark.parametrize("shape", [0.1, 0.5, 3.0, 60.0, 40000.0])
@pytest.mark.parametrize("level", [0.05, 0.3, 0.6])
def test_moving_gamma_shapes(shape, level):
    check_curve("gamma", [(shape * (1 - level), shape * (1 + level))], lambda k: (k,), 1)


@pytest.mark.parametrize("level", [0.05, 0.3, 0.6])
def test_moving_beta_shapes(level):
    ranges = [(2 - 2 * level, 2 + 2 * level)]
    check_curve("beta", ranges, lambda a: (a, a), 1)
    check_curve("beta", ranges * 2, lambda a, b: (a, b), 2)


def check_curve(family, ranges, shapes, axes):
    polynomial = ScorePolynomial.of(family, ranges)
    z = np.linspace(-z_limit(), z_limit(), 33)
    corners = [(low, (low + high) / 2, high) for low, high in ranges]
    for point in np.array(np.meshgrid(*corners)).reshape(axes, -1).T:
        c = polynomial.coefficients
        for x, axis in zip(point[::-1], polynomial.axes[::-1]):
            low, high, at = axis.low, axis.high, x
            if axis.logs:
                low, high, at = math.log(low), math.log(high), math.log(x)
            t = (2 * at - low - high) / (high - low)
            c = np.polynomial.polynomial.polyval(t, np.moveaxis(c, -1, 0))
        found = np.polynomial.polynomial.polyval(z / polynomial.limit, c)
        exact = curve(family, shapes(*point), z, 1e-6)
        relative = np.abs(found - exact) / math.sqrt(sum(shapes(*point)))
        assert relative.max() < 2e-4


def test_draws_have_the_law(spark):
    ids = spark.range(200_000)
    for family, (params, _) in CLOSED.items():
        x = draw(ids, "id", "x", family, params).agg(F.avg("x"), F.stddev("x")).first()
        mean, std = {
            "normal": (3, 2), "lognormal": (7 * math.exp(0.125), 7 * math.exp(0.125) * math.sqrt(math.exp(0.25) - 1)),
            "exponential": (4, 4), "weibull": (4 * math.gamma(1 + 2 / 3), 4 * math.sqrt(math.gamma(7 / 3) - math.gamma(5 / 3) ** 2)),
            "uniform": (1.5, 5 / math.sqrt(12)), "beta": (2.5, 3 * math.sqrt(0.05)),
            "gamma": (2.5, 2.5), "chi2": (2, 2),
        }[family]
        assert x[0] == pytest.approx(mean, abs=6 * std / math.sqrt(200_000))
        assert x[1] == pytest.approx(std, rel=0.02)


def test_empirical_quantile_by_brute_force(spark):
    """Small blocks, checked by sorting in Python."""
    from tabweave.functions.randomness import Rng

    rng = Rng(7)
    ids = spark.range(60)
    found = {
        r["id"]: r["x"]
        for r in empirical_quantile(
            ids, "id", "id div 20", rng.uniform("id", "p"), "x", "uniform",
            {"loc": 0.0, "scale": 1.0}, rng,
        ).collect()
    }
    rows = ids.selectExpr(
        "id", f"{rng.uniform('id', 'p')} as p", f"{rng.uniform('id', 'pool/0/__x')} as a",
        f"{rng.uniform('id', 'pool/1/__x')} as b",
    ).collect()
    for block in range(3):
        inside = [r for r in rows if r["id"] // 20 == block]
        pool = sorted([r["a"] for r in inside] + [r["b"] for r in inside])
        for r in inside:
            assert found[r["id"]] == pytest.approx(pool[int(r["p"] * (len(pool) - 1))])


def test_sorted_samples_of_any_shape(spark):
    """One block on almost all rows, ties, a block and percentiles that are null, many partitions."""
    import numpy as np

    block = "case when id % 50 = 0 then null when id % 10 = 1 then id div 300 else 7 end"
    rows = spark.range(3000).selectExpr(
        "id", f"{block} as block", "if(id % 90 = 3, null, pmod(id * 7919, 1000) / 1000.0D) as p")
    pool = rows.selectExpr("explode(array(0, 1)) as copy", "*").selectExpr(
        "struct(block as b) as __block", "id as __key",
        "case when id % 3 = 0 then 5.0D when id % 400 = 1 then null else pmod(id * 31 + copy, 997) * 1.0D end as __x")
    values, wanted = {}, []
    for r in pool.collect():
        values.setdefault(r["__block"]["b"], []).append(np.nan if r["__x"] is None else r["__x"])
    for r in rows.collect():
        own = np.sort(values[r["block"]])
        x = None if r["p"] is None else own[int(np.floor(r["p"] * (len(own) - 1)))]
        wanted.append((r["id"], None if x is None or np.isnan(x) else float(x)))
    source = rows.selectExpr("*", "id as __key", "struct(block as b) as __block", "p as __p")
    for parts, large in ((1, 10**9), (23, 10**9), (23, 100), (400, 1)):
        found = read_sorted(source, pool, "x", parts=parts, large=large).select("id", "x")
        assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_sorted_sample_of_no_rows(spark):
    empty = spark.range(0)
    found = empirical_quantile(empty, "id", "0", "0.5D", "x", "uniform", {"loc": 0.0, "scale": 1.0})
    assert found.columns == ["id", "x"] and found.count() == 0
