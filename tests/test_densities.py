"""Quantiles inverted from densities against closed forms."""

import math

import numpy as np
import pytest

from tabweave.functions.densities import invert
from tabweave.functions.normal import normal_quantile, quantile_parts
from tabweave.operators import laws
from tabweave.operators.draws import evaluate


def logistic(x):
    return -np.abs(x) - 2.0 * np.log1p(np.exp(-np.abs(x)))


KNOWN = {
    "normal": (lambda x: -x * x / 2, "real", None),
    "logistic": (logistic, "real", lambda u: math.log(u / (1 - u))),
    "gumbel": (lambda x: -x - np.exp(-x), "real", lambda u: -math.log(-math.log(u))),
    "log-logistic": (lambda x: -2 * np.log1p(x), "positive", lambda u: u / (1 - u)),
    "power": (lambda x: 2 * np.log(x), "unit", lambda u: u ** (1 / 3)),
    "exponential": (lambda x: 700 - x, "positive", lambda u: -math.log1p(-u)),
}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_closed_forms(spark, name):
    density, support, quantile = KNOWN[name]
    curve = invert(density, support)
    assert curve.error < 1e-7
    us = [1e-6, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-5, 1 - 1e-6]
    rows = spark.createDataFrame([(u,) for u in us], "u double").selectExpr("u", *quantile_parts("u", "n"))
    rows = rows.selectExpr("u", f"{normal_quantile('n')} as z").selectExpr("u", "z", f"{curve.value('z')} as x")
    for r in rows.collect():
        assert math.isclose(r.x, quantile(r.u) if quantile else r.z, rel_tol=3e-7, abs_tol=3e-7), (name, r)


@pytest.mark.parametrize("density,support", [
    (lambda x: -np.log1p(x * x), "real"),               # tails too heavy
    (lambda x: -np.abs(x), "real"),                     # a kink
    (lambda x: np.where(np.abs(x) < 1, 0.0, -np.inf), "real"),  # edges
    (lambda x: np.full_like(x, np.nan), "real"),
    (lambda x: 0.0 * x, "real"),                        # no tails
])
def test_what_cannot_be_inverted_raises(density, support):
    with pytest.raises(ValueError):
        invert(density, support)


def test_percentiles_beyond_the_floor_are_clipped(spark):
    curve = invert(logistic)
    far = spark.createDataFrame([(50.0,), (curve.limit,)], "z double").selectExpr(f"{curve.value('z')} as x")
    a, b = (r.x for r in far.collect())
    assert a == b


def test_registered_density(spark, monkeypatch):
    monkeypatch.setattr(laws, "FAMILIES", dict(laws.FAMILIES))
    with pytest.raises(ValueError):
        laws.register_density("bad", logistic, {"loc": "mean"})
    laws.register_density("waiting", lambda x: -x, {"scale": "mean"}, "positive")
    df = spark.createDataFrame([(2.0,), (6.0,), (None,)], "x double")
    law = laws.fit_family(df, ["x"], "waiting").first()
    assert (law.family, law.p_scale, law.p_loc) == ("waiting", 4.0, None)
    monkeypatch.setattr("tabweave.operators.draws.FAMILIES", laws.FAMILIES)
    rows = spark.createDataFrame([(0.25,), (0.9,)], "u double")
    for r in evaluate(rows, "u", "y", "waiting", {"scale": 4.0}).collect():
        assert math.isclose(r.y, -4.0 * math.log1p(-r.u), rel_tol=1e-6)
