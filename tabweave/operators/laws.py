"""Distribution families: moment fits, the automatic choice, and the registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions import quantiles as Q
from tabweave.functions.densities import Inversion, LogDensity, invert
from tabweave.functions.repair import positive
from tabweave.functions.text import Sql, string
from tabweave.operators.profile import per_column

MIN_POSITIVES = 10   # fixed value: fewer positive values than this give a normal law

# Model parameters, in the order of the law table's columns.
PARAMETERS = ("loc", "scale", "shape", "s", "c", "a", "b", "df")
LAW_SCHEMA = "col_name string, family string, " + ", ".join(
    f"p_{p} {'bigint' if p == 'df' else 'double'}" for p in PARAMETERS
)


def law(family: str, **params: Sql) -> Sql:
    """A law as a struct whose fields are the law table's columns."""
    fields = ["'family'", string(family)]
    for p in PARAMETERS:
        kind = "bigint" if p == "df" else "double"
        fields += [f"'p_{p}'", f"cast({params.get(p, 'null')} as {kind})"]
    return f"named_struct({', '.join(fields)})"


def moments(df: DataFrame, cols: list[str], *, positive_only: bool = False) -> DataFrame:
    """n, mean, population std, min, max and log moments per column, one pass."""
    x = positive("value") if positive_only else "value"
    logs = f"ln(if({x} + 1e-10D > 0, {x} + 1e-10D, null))"
    return per_column(df, cols, {
        "n": f"count({x})",
        "mean": f"avg({x})",
        "std": f"stddev_pop({x})",
        "min": f"min({x})",
        "max": f"max({x})",
        "log_mean": f"avg({logs})",
        "log_std": f"stddev_pop({logs})",
    })


@dataclass(frozen=True)
class Family:
    """A distribution family.

    ``fit`` gives parameters as SQL over the columns of :func:`moments`.
    ``quantile(draw, params)`` turns a draw into a value, also as SQL.  ``uses``
    names the part of the draw it reads: ``"z"`` (standard normal), ``"u"``
    (percentile) or ``"score"`` (a score polynomial over the parameters in
    ``table``).  A family without a quantile has a ``sampler(uniform, params)``,
    where ``uniform(name)`` is an independent uniform for each name; its quantiles
    are read from sorted samples.
    """

    name: str
    fit: dict[str, Sql]
    quantile: Callable[[Q.Draw, Q.Params], Sql] | None
    uses: str = "u"
    table: tuple[str, ...] = ()
    sampler: Callable[[Callable[[str], Sql], Q.Params], Sql] | None = None


FAMILIES: dict[str, Family] = {}


def register_family(
    name: str,
    quantile: Callable[[Q.Draw, Q.Params], Sql] | None,
    fit: dict[str, Sql],
    uses: str = "u",
    sampler: Callable[[Callable[[str], Sql], Q.Params], Sql] | None = None,
) -> None:
    """Add a family; its parameters must be among PARAMETERS.

    Give either ``quantile`` or, for a law that can only be drawn from, ``sampler``.
    """
    if (quantile is None) == (sampler is None):
        raise ValueError("give either a quantile or a sampler")
    if uses not in ("u", "z"):
        raise ValueError("a registered family reads 'u' or 'z'")
    if not set(fit) <= set(PARAMETERS):
        raise ValueError(f"parameters must be among {PARAMETERS}")
    FAMILIES[name] = Family(name, fit, quantile, "u" if sampler else uses, sampler=sampler)


def register_density(
    name: str, log_density: LogDensity, fit: dict[str, Sql], support: str = "real", tolerance: float = 1e-7,
) -> Inversion:
    """Add a family of which only the density is known: values are loc + scale * x.

    ``log_density`` is the logarithm of x's density, up to a constant, over a numpy array;
    ``fit`` gives ``scale`` and, if the family moves, ``loc``.  The curve is inverted here,
    once; the result tells its error.  Percentiles are clipped to [1e-6, 1 - 1e-6].
    """
    if not {"scale"} <= set(fit) <= {"loc", "scale"}:
        raise ValueError("the fit of a density gives 'scale' and perhaps 'loc'")
    curve = invert(log_density, support, tolerance=tolerance)
    register_family(name, lambda draw, p: f"{p.get('loc', '0.0D')} + {p['scale']} * {curve.value(draw.z)}", fit, "z")
    return curve


_SPAN = {"loc": "min", "scale": "max - min"}
_WHOLE_MEAN = "greatest(cast(mean as bigint), 1L)"

# Fixed values inside the fits: the floors 1e-6 and 0.1, weibull c = 1.5 and
# beta a = b = 2.
for _family in (
    Family("normal", {"loc": "mean", "scale": "greatest(std, 1e-6D)"}, Q.normal, "z"),
    Family("lognormal", {"s": "log_std", "scale": "exp(log_mean)"}, Q.lognormal, "z"),
    Family(
        "gamma",
        {
            "shape": "greatest(power(mean / greatest(std, 1e-6D), 2.0D), 0.1D)",
            "scale": "greatest(std * std / greatest(mean, 1e-6D), 0.1D)",
        },
        Q.gamma, "score", ("shape",),
    ),
    Family("exponential", {"scale": "mean"}, Q.exponential),
    Family("weibull", {"c": "1.5D", "scale": "mean"}, Q.weibull),
    Family("beta", {"a": "2.0D", "b": "2.0D", **_SPAN}, Q.beta, "score", ("a", "b")),
    Family("uniform", _SPAN, Q.uniform),
    Family("chi2", {"df": _WHOLE_MEAN}, Q.chi2, "score", ("df",)),
):
    FAMILIES[_family.name] = _family


def fit_family(df: DataFrame, cols: list[str], family: str) -> DataFrame:
    """Fit one given family to every column: a law table."""
    return (
        moments(df, cols)
        .selectExpr("position", "col_name", f"{law(family, **FAMILIES[family].fit)} as law")
        .select("position", "col_name", "law.*")
    )


def choose_laws(profile: DataFrame, positives: DataFrame, kurtosis: str = "excess") -> DataFrame:
    """Pick a family per column by its positive values and overall shape.

    ``positives`` comes from ``moments(sample, cols, positive_only=True)``.
    The thresholds compare the profile's excess kurtosis as it is;
    ``kurtosis="raw"`` adds 3 first, as they were meant for.
    """
    # The thresholds of the rules below, in the order they are tried.
    k = "(p.kurtosis + 3)" if kurtosis == "raw" else "p.kurtosis"
    normal = law("normal", loc="s.mean", scale="s.std")
    span = {"loc": "s.min", "scale": "s.max - s.min"}
    gamma = {
        "shape": "if(s.std > 0, greatest(power(try_divide(s.mean, s.std), 2.0D), 0.1D), null)",
        "scale": "greatest(try_divide(s.std * s.std, s.mean), 0.1D)",
    }
    lognormal = {"s": "greatest(try_divide(s.std, s.mean), 0.1D)", "scale": "s.mean"}
    rules = [
        (f"coalesce(s.n, 0) < {MIN_POSITIVES}",
         law("normal", loc="p.mean_nonzero", scale="p.std_nonzero")),
        ("s.max <= 1", law("beta", a="2.0D", b="2.0D", **span)),
        ("p.skewness > 2", law("exponential", scale="s.mean")),
        (f"p.skewness > 0.5 and {k} > 3", law("lognormal", **lognormal)),
        ("p.skewness > 0.5", law("gamma", **gamma)),
        (f"abs(p.skewness) < 0.5 and abs({k} - 3) < 1", normal),
        (f"{k} < 1.5", law("uniform", **span)),
        (f"{k} > 5", law("chi2", df="greatest(cast(s.mean as bigint), 1L)")),
    ]
    cases = " ".join(f"when {condition} then {outcome}" for condition, outcome in rules)
    # both sides hold one row per modelled column
    return (
        profile.where("not is_binary").alias("p")
        .join(F.broadcast(positives.alias("s")), "col_name")
        .selectExpr("p.position", "col_name", f"case {cases} else {normal} end as law")
        .select("position", "col_name", "law.*")
    )
