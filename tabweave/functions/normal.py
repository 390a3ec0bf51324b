"""The standard normal CDF and quantile function.

Both are built from arithmetic only, so they stay inside generated JVM code.
Pass a plain column (not a long expression): the argument is used many times.
"""

from __future__ import annotations

import numpy as np

from tabweave.functions.text import Sql, double

# Hart's rational approximation of the normal tail (Hart 1968,
# as published by West 2005), highest power first.
CDF_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

# Wichura's algorithm AS 241 (PPND16), highest power first.
CENTRE_NUMERATOR = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
    4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
    1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRE_DENOMINATOR = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
    2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
    4.2313330701600911252e1, 1.0,
)
MIDDLE_NUMERATOR = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
    1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
    4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_DENOMINATOR = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
    1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
    2.05319162663775882187e0, 1.0,
)
TAIL_NUMERATOR = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
    2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
    5.46378491116411436990e0, 6.65790464350110377720e0,
)
TAIL_DENOMINATOR = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
    7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
    5.99832206555887937690e-1, 1.0,
)


def horner(coefficients, x: Sql) -> Sql:
    """Polynomial in x, coefficients from the highest power down."""
    total = double(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {double(c)})"
    return total


def ratio(top: Sql, bottom: Sql) -> Sql:
    """Quotient by a denominator known to be nonzero, typed as never null."""
    return f"coalesce({top} / {bottom}, 0.0D)"


def normal_cdf(z: Sql) -> Sql:
    """P(Z <= z); absolute error below 1e-14 for |z| < 7."""
    y = f"abs({z})"
    tail = f"exp(-0.5D * {z} * {z}) * " + ratio(
        horner(CDF_NUMERATOR, y), horner(CDF_DENOMINATOR, y)
    )
    return f"if({z} <= 0.0D, {tail}, 1.0D - {tail})"


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    """The same for an array inside a task."""
    y = np.abs(z)
    tail = np.exp(-0.5 * z * z) * np.polyval(CDF_NUMERATOR, y) / np.polyval(CDF_DENOMINATOR, y)
    return np.where(z <= 0.0, tail, 1.0 - tail)


def quantile_parts(p: Sql, name: str) -> list[Sql]:
    """Named intermediate columns for :func:`normal_quantile`; 0 < p < 1.

    They belong in a projection of their own, below the one that uses them.
    Written as one expression they would be repeated dozens of times.
    """
    return [
        f"{p} - 0.5D as {name}_q",
        f"0.180625D - ({p} - 0.5D) * ({p} - 0.5D) as {name}_s",
        f"sqrt(-coalesce(ln(least({p}, 1.0D - {p})), 0.0D)) as {name}_r",
    ]


def normal_quantile(name: str) -> Sql:
    """Inverse of :func:`normal_cdf`, over the columns of :func:`quantile_parts`."""
    q, s, r = f"{name}_q", f"{name}_s", f"{name}_r"
    m, t = f"({r} - 1.6D)", f"({r} - 5.0D)"
    centre = f"{q} * " + ratio(horner(CENTRE_NUMERATOR, s), horner(CENTRE_DENOMINATOR, s))
    middle = ratio(horner(MIDDLE_NUMERATOR, m), horner(MIDDLE_DENOMINATOR, m))
    tail = ratio(horner(TAIL_NUMERATOR, t), horner(TAIL_DENOMINATOR, t))
    return (
        f"if(abs({q}) <= 0.425D, {centre},"
        f" if({q} < 0.0D, -1.0D, 1.0D) * if({r} <= 5.0D, {middle}, {tail}))"
    )


def normal_quantile_array(p: np.ndarray) -> np.ndarray:
    """The same inverse for an array inside a task; NaN stays NaN."""

    def by(top, bottom, x):
        return np.polyval(top, x) / np.polyval(bottom, x)

    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    centre = q * by(CENTRE_NUMERATOR, CENTRE_DENOMINATOR, 0.180625 - q * q)
    outer = np.where(r <= 5.0, by(MIDDLE_NUMERATOR, MIDDLE_DENOMINATOR, r - 1.6),
                     by(TAIL_NUMERATOR, TAIL_DENOMINATOR, r - 5.0))
    return np.where(np.abs(q) <= 0.425, centre, np.sign(q) * outer)
