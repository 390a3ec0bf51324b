"""The registered queries as SQL for another engine (DuckDB dialect).

Written separately from the library: plain window functions and closed forms
over whole tables.  Only the published coefficients of the normal CDF and
quantile are shared.
"""

from __future__ import annotations

from tabweave.functions import normal as N

SQL: dict[str, str] = {}
SEED = 42
BLOCK = 100
LEVELS = (0.0, 0.05, 0.1, 0.2, 0.3)
NUMERIC = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "events": ["event_id", "user_id", "value"],
    "documents": ["doc_id", "n_chars"],
}
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MODELLED = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
PARAMETERS = ("loc", "scale", "shape", "s", "c", "a", "b", "df")
EIGHT = ("normal", "lognormal", "gamma", "exponential", "weibull", "beta", "uniform", "chi2")


def d(x: float) -> str:
    return f"({x!r})::DOUBLE"


def rnd(x: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0.0)"


def uniform(tag: str, key: str) -> str:
    digits = f"substr(md5('{SEED}:{tag}:' || {key}), 1, 13)"
    return f"((('0x' || {digits})::BIGINT::DOUBLE + 0.5::DOUBLE) * {d(2.0 ** -52)})"


def between(u: str, low: str, high: str) -> str:
    return f"({low} + ({high} - {low}) * {u})"


def factor(tag: str, key: str, level: str) -> str:
    return between(uniform(tag, key), f"(1::DOUBLE - {level})", f"(1::DOUBLE + {level})")


def polynomial(coefficients, x: str) -> str:
    total = d(coefficients[0])
    for c in coefficients[1:]:
        total = f"({total} * {x} + {d(c)})"
    return total


def cdf(z: str) -> str:
    tail = (
        f"exp({d(-0.5)} * {z} * {z}) * {polynomial(N.CDF_NUMERATOR, f'abs({z})')}"
        f" / {polynomial(N.CDF_DENOMINATOR, f'abs({z})')}"
    )
    return f"(CASE WHEN {z} <= 0 THEN {tail} ELSE 1 - {tail} END)"


def inverse(p: str) -> str:
    q, s, r = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    def ratio(top, bottom, x):
        return f"{polynomial(top, x)} / {polynomial(bottom, x)}"
    return (
        f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(N.CENTRE_NUMERATOR, N.CENTRE_DENOMINATOR, s)}"
        f" ELSE sign({q}) * CASE WHEN {r} <= 5 THEN"
        f" {ratio(N.MIDDLE_NUMERATOR, N.MIDDLE_DENOMINATOR, f'({r} - 1.6)')} ELSE"
        f" {ratio(N.TAIL_NUMERATOR, N.TAIL_DENOMINATOR, f'({r} - 5)')} END END)"
    )


# --- statistics --------------------------------------------------------------

def statistics(source: str, col: str, sample: bool = False) -> str:
    """One profile row of a column; ``source`` is a table or a query in brackets."""
    skew, kurt, std_pos = "skew_pop", "kurt_pop", "stddev_pop(x) FILTER (x > 0)"
    if sample:
        skew, kurt = "skewness(x)", "kurtosis(x)"
        std_pos = "stddev_samp(x) FILTER (x > 0)"
    else:
        skew = "avg(power((x - mu) / nullif(sd, 0), 3))"
        kurt = "avg(power((x - mu) / nullif(sd, 0), 4)) - 3"
    return f"""SELECT '{col}' AS col_name, coalesce(avg(x), 0) AS mean, coalesce(stddev_samp(x), 0) AS std,
        CASE WHEN count(*) FILTER (x > 0) > 0 THEN avg(x) FILTER (x > 0) ELSE coalesce(avg(x), 0) END AS mean_nonzero,
        CASE WHEN count(*) FILTER (x > 0) > 0 THEN {std_pos} ELSE coalesce(stddev_samp(x), 0) END AS std_nonzero,
        coalesce({skew}, 0) AS skewness, coalesce({kurt}, 0) AS kurtosis, min(x) AS min, max(x) AS max,
        count(DISTINCT raw) <= 10 AS is_binary, count(DISTINCT raw) AS unique_count,
        count(*) FILTER (x = 0) / count(*)::DOUBLE AS zero_ratio
        FROM (SELECT {col} AS raw, {col}::DOUBLE AS x, avg({col}::DOUBLE) OVER () AS mu,
              stddev_pop({col}::DOUBLE) OVER () AS sd FROM {source})"""


def moments(source: str, col: str, positive: bool = False) -> str:
    keep = f"WHERE {col} > 0" if positive else ""
    return f"""SELECT '{col}' AS col_name, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min,
        max(x) AS max, avg(ln(CASE WHEN x + 1e-10 > 0 THEN x + 1e-10 END)) AS log_mean,
        stddev_pop(ln(CASE WHEN x + 1e-10 > 0 THEN x + 1e-10 END)) AS log_std
        FROM (SELECT {col}::DOUBLE AS x FROM {source} {keep})"""


def union(parts) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def show_profile(parts, drop=()) -> str:
    digits = {**dict.fromkeys(("mean", "std", "mean_nonzero", "std_nonzero", "min", "max"), 4),
              **dict.fromkeys(("skewness", "kurtosis", "zero_ratio"), 6)}
    cols = ["col_name", "mean", "std", "mean_nonzero", "std_nonzero", "skewness", "kurtosis",
            "min", "max", "is_binary", "unique_count", "zero_ratio"]
    shown = ", ".join(
        f"{rnd(c, digits[c])} AS {c}" if c in digits else c for c in cols if c not in drop
    )
    return f"SELECT {shown} FROM ({union(parts)})"


for _t, _cols in NUMERIC.items():
    SQL[f"profile_{_t}"] = show_profile([statistics(_t, c) for c in _cols])
SQL["profile_sample_bias"] = show_profile([statistics("orders", c, True) for c in NUMERIC["orders"]])
SQL["profile_flags"] = show_profile(
    [statistics("lineitem", c) for c in NUMERIC["lineitem"]], drop=("unique_count",)
)
SQL["profile_merged"] = f"""SELECT * EXCLUDE (unique_count), least(unique_count, 11) AS distinct_up_to_11,
    (SELECT count(*) FROM lineitem) AS n_rows FROM ({SQL["profile_lineitem"]})"""
SQL["numeric_columns"] = union(
    f"SELECT {i}::INTEGER AS position, '{c}' AS col_name, count({c}) AS non_null FROM lineitem"
    for i, c in enumerate(NUMERIC["lineitem"])
)
SQL["positive_moments"] = f"""SELECT col_name, n, {rnd('mean', 4)} AS mean, {rnd('std', 4)} AS std,
    {rnd('min', 4)} AS min, {rnd('max', 4)} AS max, {rnd('log_mean', 6)} AS log_mean,
    {rnd('log_std', 6)} AS log_std FROM ({moments('customer', 'c_acctbal', True)})"""
SQL["zero_ratio"] = union(
    f"SELECT '{c}' AS col_name, {rnd(f'count(*) FILTER ({c} = 0) / count(*)::DOUBLE', 9)} AS zero_ratio"
    " FROM lineitem" for c in ("l_discount", "l_tax")
)
SQL["discrete_flags"] = union(
    f"SELECT '{c}' AS col_name, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) <= 10 AS is_binary"
    " FROM lineitem" for c in NUMERIC["lineitem"]
)


def shares(source: str, col: str) -> str:
    return f"""SELECT '{col}' AS col_name, {col}::DOUBLE AS value,
        count(*) / (sum(count(*)) OVER ())::DOUBLE AS p
        FROM {source} WHERE {col} IS NOT NULL GROUP BY {col}"""


def cumulated(source: str, col: str) -> str:
    """Smoothed and cumulated shares of one column."""
    return f"""SELECT col_name, value, p, sum(p) OVER (ORDER BY value) AS cum FROM (
        SELECT col_name, value, (p + 0.01::DOUBLE) / (sum(p) OVER () + 0.01::DOUBLE * count(*) OVER ()) AS p
        FROM ({shares(source, col)}))"""


SQL["category_frequencies"] = "SELECT col_name, value, {} AS p FROM ({})".format(
    rnd("p", 9),
    union([shares("lineitem", "l_linenumber"), shares("lineitem", "l_tax"),
           shares("labels", "quality"), shares("labels", "toxic")]),
)
SQL["smoothed_frequencies"] = "SELECT col_name, value, {} AS p, {} AS cum FROM ({})".format(
    rnd("p", 9), rnd("cum", 9),
    union([cumulated("lineitem", "l_linenumber"), cumulated("lineitem", "l_tax")]),
)


def key_text(keys) -> str:
    return f"concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in keys)})"


def sample_of(table: str, keys, k: int) -> str:
    order = ", ".join([uniform("sample", key_text(keys)), *keys])
    return f"(SELECT * FROM {table} ORDER BY {order} LIMIT {k})"


SQL["bounded_sample"] = (
    f"SELECT o_orderkey, o_totalprice FROM {sample_of('orders', ['o_orderkey'], 1000)}"
)
SQL["bounded_sample_half"] = (
    f"SELECT {', '.join(LINEITEM_KEY)}, l_quantity FROM "
    + sample_of("lineitem", LINEITEM_KEY, "(SELECT count(*) // 2 FROM lineitem)"))

# --- laws --------------------------------------------------------------------

FITS = {
    "normal": {"loc": "mean", "scale": "greatest(std, 1e-6)"},
    "lognormal": {"s": "log_std", "scale": "exp(log_mean)"},
    "gamma": {"shape": "greatest(power(mean / greatest(std, 1e-6), 2), 0.1)",
              "scale": "greatest(std * std / greatest(mean, 1e-6), 0.1)"},
    "exponential": {"scale": "mean"},
    "weibull": {"c": "1.5", "scale": "mean"},
    "beta": {"a": "2.0", "b": "2.0", "loc": "min", "scale": "max - min"},
    "uniform": {"loc": "min", "scale": "max - min"},
    "chi2": {"df": "greatest(trunc(mean)::BIGINT, 1)"},
}


def law_columns(params: dict[str, str], digits: int | None = 6) -> str:
    out = []
    for p in PARAMETERS:
        value = f"({params.get(p, 'NULL')})::DOUBLE"
        out.append(f"{rnd(value, digits) if digits and p != 'df' else value} AS p_{p}")
    return ", ".join(out)


for _f in EIGHT:
    SQL[f"fit_{_f}"] = union(
        f"SELECT col_name, '{_f}' AS family, {law_columns(FITS[_f])} FROM ({moments(t, c)})"
        for t, c in (("orders", "o_totalprice"), ("part", "p_retailprice"), ("part", "p_size"),
                     ("events", "value"))
    )


def chosen(source: str, col: str, fit_source: str | None = None, raw: bool = False) -> str:
    """The automatic choice for one column: family, parameters, and statistics."""
    k = "(p.kurtosis + 3)" if raw else "p.kurtosis"
    return f"""SELECT *, CASE rule WHEN 0 THEN 'normal' WHEN 1 THEN 'beta' WHEN 2 THEN 'exponential'
          WHEN 3 THEN 'lognormal' WHEN 4 THEN 'gamma' WHEN 5 THEN 'normal' WHEN 6 THEN 'uniform'
          WHEN 7 THEN 'chi2' ELSE 'normal' END AS family,
        CASE WHEN rule = 0 THEN mean_nonzero WHEN rule IN (1, 6) THEN s_min
             WHEN rule IN (5, 8) THEN s_mean END AS loc,
        CASE rule WHEN 0 THEN std_nonzero WHEN 2 THEN s_mean WHEN 3 THEN s_mean
             WHEN 4 THEN greatest(s_std * s_std / s_mean, 0.1) WHEN 5 THEN s_std WHEN 8 THEN s_std
             WHEN 7 THEN NULL ELSE s_max - s_min END AS scale,
        CASE rule WHEN 4 THEN greatest(power(s_mean / s_std, 2), 0.1) END AS shape,
        CASE rule WHEN 3 THEN greatest(s_std / s_mean, 0.1) END AS s,
        NULL AS c, CASE rule WHEN 1 THEN 2.0 END AS a, CASE rule WHEN 1 THEN 2.0 END AS b,
        CASE rule WHEN 7 THEN greatest(trunc(s_mean)::BIGINT, 1) END AS df
      FROM (SELECT p.*, s.n AS s_n, s.mean AS s_mean, s.std AS s_std, s.min AS s_min, s.max AS s_max,
          CASE WHEN s.n < 10 THEN 0 WHEN s.max <= 1 THEN 1 WHEN p.skewness > 2 THEN 2
            WHEN p.skewness > 0.5 AND {k} > 3 THEN 3 WHEN p.skewness > 0.5 THEN 4
            WHEN abs(p.skewness) < 0.5 AND abs({k} - 3) < 1 THEN 5 WHEN {k} < 1.5 THEN 6
            WHEN {k} > 5 THEN 7 ELSE 8 END AS rule
        FROM ({statistics(source, col)}) p, ({moments(fit_source or source, col, True)}) s)"""


def show_laws(parts) -> str:
    return (
        f"SELECT col_name, family, {law_columns({p: p for p in PARAMETERS})}"
        f" FROM ({union(parts)}) WHERE NOT is_binary"
    )


SQL["choose_family"] = show_laws(chosen(t, c) for t, cols in NUMERIC.items() for c in cols)
SQL["choose_family_merged"] = show_laws(chosen(t, c) for t in ("orders", "customer") for c in NUMERIC[t])

_u = {t: uniform(f"derived/{t}", "o_orderkey") for t in "abcdefghqs"}


def _heavy(power: float) -> str:
    return f"100 + CASE WHEN s < 0.5 THEN -1 ELSE 1 END * power(-ln(e), {d(power)})"


DERIVED = f"""(SELECT o_orderkey, CASE WHEN o_orderkey < 5 THEN 1 + o_orderkey ELSE -f END AS fewpos, f AS frac, expo,
      10 * exp({d(0.4)} * z) AS lognorm, -ln(a) - ln(b) - ln(c) - ln(d) AS erlang4,
      {_heavy(1.0)} AS laplace, z + 10 AS gauss, {_heavy(1.3)} AS heavy, {_heavy(0.9)} AS mid,
      CASE WHEN q < 0.3 THEN 0 ELSE expo END AS zeroinfl, floor(5 * f) AS disc
    FROM (SELECT *, sqrt(-2 * ln(g)) * cos(2 * pi() * h) AS z, -100 * ln(e) AS expo
      FROM (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _u.items())} FROM orders)))"""
DERIVED_COLUMNS = ("fewpos", "frac", "expo", "lognorm", "erlang4", "laplace", "gauss", "heavy",
                   "mid", "zeroinfl", "disc")
for _name, _raw in (("choose_family_derived", False), ("choose_family_raw_kurtosis", True)):
    SQL[_name] = f"WITH derived AS MATERIALIZED {DERIVED} " + show_laws(
        chosen("derived", c, raw=_raw) for c in DERIVED_COLUMNS
    )

# --- dependence --------------------------------------------------------------

SQL["average_ranks"] = union(
    f"""SELECT {i}::INTEGER AS position, {c} AS value, count(*) AS ties,
    (sum(count(*)) OVER (ORDER BY {c}) - (count(*) - 1) / 2.0)::DOUBLE AS rank
    FROM lineitem GROUP BY {c}""" for i, c in enumerate(("l_quantity", "l_extendedprice"))
)


def scores(source: str, cols) -> str:
    """Normal scores of columns, as z_0, z_1, ..."""
    ranked = ", ".join(
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE - 0.5::DOUBLE)"
        f" / count(*) OVER () AS p_{i}" for i, c in enumerate(cols)
    )
    return (
        f"SELECT {', '.join(f'{inverse(f'p_{i}')} AS z_{i}' for i in range(len(cols)))}"
        f" FROM (SELECT {ranked} FROM {source})"
    )


def show_correlation(source: str, cols) -> str:
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return f"WITH scores AS MATERIALIZED ({scores(source, cols)}) " + union(
        f"SELECT '{cols[i]}' AS col_i, '{cols[j]}' AS col_j, {rnd(f'corr(z_{i}, z_{j})', 7)} AS rho FROM scores"
        for i, j in pairs
    )


SQL["normal_score_corr"] = show_correlation("lineitem", MODELLED)
SQL["normal_score_corr_sample"] = show_correlation(sample_of("lineitem", LINEITEM_KEY, 5000), MODELLED)

# --- indeterminacy -----------------------------------------------------------

BLOCKS = f"(SELECT DISTINCT o_orderkey // {BLOCK} AS block FROM orders)"


def widened(params: dict[str, str], g) -> dict[str, str]:
    out = {}
    for p, value in params.items():
        moved = f"({value}) * {g(p)}"
        if p == "df":
            out[p] = f"greatest(trunc({moved})::BIGINT, 1)"
        else:
            out[p] = moved if p == "loc" else f"greatest({moved}, 1e-6)"
    return out


for _mode in ("shared", "independent"):
    SQL[f"fuzz_{_mode}"] = f"WITH m AS ({moments('orders', 'o_totalprice')}) " + union(
        f"SELECT block, '{f}' AS family, " + law_columns(
            widened(FITS[f], lambda p, f=f: factor(
                f"{f}/g" if _mode == "shared" else f"{f}/g/{p}", "block", d(0.1))), 5)
        + f" FROM {BLOCKS}, m" for f in EIGHT
    )
SQL["fuzz_fallback_normal"] = f"""SELECT block,
    {rnd(f"mean_nonzero * {factor('o_totalprice/g/loc', 'block', d(0.2))}", 4)} AS mu,
    {rnd(f"greatest(std_nonzero, 1e-6) * {factor('o_totalprice/g/scale', 'block', d(0.2))}", 4)} AS sigma
    FROM {BLOCKS}, ({statistics('orders', 'o_totalprice')})"""
LEVEL_ROWS = f"(VALUES {', '.join(f'({d(x)})' for x in LEVELS)}) levels(in_level)"
SQL["in_sweep"] = f"""SELECT block, in_level, {rnd(factor('o_totalprice/g', 'block', 'in_level'), 12)} AS g
    FROM {BLOCKS}, {LEVEL_ROWS}"""

# --- draws -------------------------------------------------------------------

SQL["row_ids"] = "SELECT range AS id FROM range((SELECT count(*) FROM orders))"
SQL["uniform_draw"] = f"""SELECT o_orderkey,
    {rnd(between(uniform('price/u', 'o_orderkey'), d(0.001), d(0.999)), 12)} AS u FROM orders"""
CORRELATED = f"""WITH scores AS ({scores('orders', ['o_custkey', 'o_totalprice'])}),
    rho AS (SELECT corr(z_0, z_1) AS rho FROM scores),
    polar AS (SELECT o_orderkey, sqrt({d(-2.0)} * ln({uniform('copula/0/r', 'o_orderkey')})) AS r,
      {uniform('copula/0/a', 'o_orderkey')} * 2 * pi() AS a FROM orders),
    z AS (SELECT o_orderkey, r * cos(a) AS z0, rho * (r * cos(a)) + sqrt(1 - rho * rho) * (r * sin(a)) AS z1
      FROM polar, rho)"""
SQL["correlated_normals"] = (
    f"{CORRELATED} SELECT o_orderkey, {rnd('z0', 8)} AS z0, {rnd('z1', 8)} AS z1 FROM z"
)
SQL["copula_uniforms"] = (
    f"{CORRELATED} SELECT o_orderkey, {rnd(cdf('z0'), 8)} AS u0, {rnd(cdf('z1'), 8)} AS u1 FROM z"
)


def closed_form(family: str, u: str, z: str) -> str:
    """Quantile over columns loc, scale, s, c."""
    return {
        "normal": f"loc + scale * {z}",
        "lognormal": f"scale * exp(s * {z})",
        "exponential": f"-scale * ln(1 - {u})",
        "weibull": f"scale * power(-ln(1 - {u}), 1 / c)",
        "beta": f"loc + scale * (0.5 - sin(asin(1 - 2 * {u}) / 3))",
        "uniform": f"loc + scale * {u}",
    }[family]


def value_law(family: str) -> str:
    fit = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in FITS[family].items())
    return f"(SELECT {fit} FROM ({moments('events', 'value')}))"


def clipped(u: str, floor: float) -> str:
    return f"least(greatest({u}, {d(floor)}), {d(1.0 - floor)})"


def gamma_sum(k: str, t: str, terms: int = 400) -> str:
    """P(k, exp t) as a sum of Poisson-like terms."""
    return f"(SELECT sum(exp(({k} + n) * {t} - exp({t}) - lgamma({k} + n + 1))) FROM range({terms}) r(n))"


def beta_sum(a: str, b: str, x: str, terms: int) -> str:
    """I_x(a, b) as a hypergeometric sum; for x up to about a half."""
    return (f"(SELECT sum(exp({a} * ln({x}) + {b} * ln(1 - {x}) - lgamma({a} + 1 + n) - lgamma({b})"
            f" + lgamma({a} + {b} + n) + n * ln({x}))) FROM range({terms}) r(n))")


def nearer(gap: str, density: str, slope: str, t: str = "t") -> str:
    """One step of Halley's method from t."""
    return f"({t} - ({gap}) / ({density}) / (1 - 0.5 * ({gap}) / ({density}) * ({slope})))"


def gamma_step(k: str, u: str) -> str:
    """t = ln x of the gamma quantile, from a near one."""
    return nearer("p - u", "w", f"{k} - exp(t)"), (
        f"{gamma_sum(k, 't')} AS p, exp({k} * t - exp(t) - lgamma({k})) AS w, {u} AS u")


def integrated(family: str, u: str) -> str:
    """Gamma quantiles by integrating the density over ln x, looking u up, and one Halley step."""
    k, scale = ("shape", "scale") if family == "gamma" else ("df / 2", "2::DOUBLE")
    steps = 200_000
    step, parts = gamma_step("k", "u")
    return f"""WITH law AS (SELECT ({k})::DOUBLE AS k, {scale} AS b FROM {value_law(family)}),
      ends AS (SELECT *, (ln(1e-13) + lgamma(k + 1)) / k AS low, ln(k + 12 * sqrt(k) + 40) AS high FROM law),
      grid AS (SELECT k, b, i, low + i * (high - low) / {steps} AS t, (high - low) / {steps} AS h
        FROM ends, range({steps} + 1) r(i)),
      density AS (SELECT *, exp(k * (t - ln(k)) - (exp(t) - k)) AS f FROM grid),
      running AS (SELECT i, t, b, h, f, sum(f) OVER (ORDER BY i) AS s, first_value(f) OVER (ORDER BY i) AS f0,
        k FROM density),
      mass AS (SELECT i, t, b, k, f0 / k + h * (s - (f0 + f) / 2) AS m FROM running),
      cdf AS (SELECT t, b, k, m / max(m) OVER () AS p, lead(t) OVER (ORDER BY i) AS t2,
        lead(m / total) OVER (ORDER BY i) AS p2
        FROM (SELECT *, max(m) OVER () AS total FROM mass)),
      ids AS (SELECT o_orderkey, {u} AS u FROM orders),
      near AS MATERIALIZED (SELECT o_orderkey, u, b, k, t + (u - p) / (p2 - p) * (t2 - t) AS t
        FROM ids ASOF JOIN cdf ON ids.u >= cdf.p)
      SELECT o_orderkey, {rnd(f'b * exp({step})', 4)} AS x FROM (SELECT o_orderkey, b, k, t, {parts} FROM near)"""


for _f in EIGHT:
    _quantile = clipped(uniform("quantile", "o_orderkey"), 1e-6)
    _draw = uniform("draw/x", "o_orderkey")
    if _f in ("gamma", "chi2"):
        SQL[f"quantile_{_f}"] = integrated(_f, _quantile)
        SQL[f"draw_{_f}"] = integrated(_f, _draw)
        continue
    for _kind, _p in (("quantile", _quantile), ("draw", _draw)):
        SQL[f"{_kind}_{_f}"] = f"""SELECT o_orderkey, {rnd(closed_form(_f, 'u', inverse('u')), 6)} AS x
            FROM (SELECT o_orderkey, {_p} AS u FROM orders), {value_law(_f)}"""

def moving(tag: str, low: float, high: float) -> str:
    return between(uniform(f"shape/{tag}", "o_orderkey"), d(low), d(high))


SQL["special_functions"] = f"""WITH arguments AS MATERIALIZED (
      SELECT o_orderkey, {moving('k', 0.05, 60.0)} AS k, {moving('a', 0.2, 9.0)} AS a,
        {moving('b', 0.2, 9.0)} AS b, {uniform('special/x', 'o_orderkey')} AS v FROM orders),
    placed AS MATERIALIZED (SELECT *, ln(k * ({d(0.1)} + 2 * v)) AS t, least(v, 1 - v) AS x,
      CASE WHEN v <= 0.5 THEN a ELSE b END AS near, CASE WHEN v <= 0.5 THEN b ELSE a END AS far FROM arguments),
    summed AS (SELECT *, {gamma_sum('k', 't')} AS p, {beta_sum('near', 'far', 'x', 150)} AS i FROM placed)
    SELECT o_orderkey, {rnd('lgamma(k)', 8)} AS log_gamma, {rnd('p', 8)} AS gamma_cdf,
      {rnd('CASE WHEN v <= 0.5 THEN i ELSE 1 - i END', 8)} AS beta_cdf FROM summed"""
SQL["quantile_residuals"] = f"""SELECT o_orderkey, {rnd(clipped(uniform('residual', 'o_orderkey'), 1e-6), 9)} AS u,
    true AS gamma_within, true AS chi2_within, true AS beta_within FROM orders"""
for _name, _block in (("", "o_orderkey // 1000"), ("_one_block", "0")):
    SQL[f"empirical_quantile{_name}"] = f"""WITH law AS (SELECT * FROM {value_law('exponential')}),
    keys AS (SELECT o_orderkey, {_block} AS block FROM orders),
    pool AS (SELECT block, row_number() OVER (PARTITION BY block ORDER BY x) - 1 AS spot, x FROM (
      SELECT block, -scale * ln(1 - {uniform('pool/0/__x', 'o_orderkey')}) AS x FROM keys, law UNION ALL
      SELECT block, -scale * ln(1 - {uniform('pool/1/__x', 'o_orderkey')}) AS x FROM keys, law)),
    wanted AS (SELECT o_orderkey, block, floor({uniform('quantile', 'o_orderkey')}
      * (2 * count(*) OVER (PARTITION BY block) - 1))::BIGINT AS spot FROM keys)
    SELECT o_orderkey, {rnd('x', 6)} AS x FROM wanted JOIN pool USING (block, spot)"""
for _name, _col in (("category_draw", "l_tax"), ("category_draw_many", "l_suppkey")):
    SQL[_name] = f"""WITH shares AS MATERIALIZED ({cumulated('lineitem', _col)}),
    ids AS (SELECT o_orderkey, {uniform(f'{_col}/category', 'o_orderkey')} AS u FROM orders)
    SELECT o_orderkey, coalesce(min(value), (SELECT max(value) FROM shares))::DOUBLE AS {_col}
    FROM ids LEFT JOIN shares ON u < cum GROUP BY o_orderkey"""
SQL["zero_injection"] = f"""SELECT o_orderkey, CASE WHEN zero_ratio > 0.01
      AND {uniform('price/zero', 'o_orderkey')} < zero_ratio THEN 0 ELSE o_totalprice END AS price
    FROM orders, ({statistics('lineitem', 'l_discount')})"""
_clip = uniform("clip", "event_id")
SQL["percentile_clip"] = f"""SELECT event_id, {rnd(clipped(_clip, 1e-6), 12)} AS spark_path,
    {rnd(clipped(_clip, 0.001), 12)} AS sequential_path, 0.4::DOUBLE AS crossed FROM events"""
SQL["range_clip"] = f"""SELECT c_custkey,
    {rnd('least(greatest(c_acctbal * 1.5 - 1000, min * 0.9::DOUBLE), max * 1.1::DOUBLE)', 6)} AS balance,
    {rnd('least(greatest(c_acctbal, -9::DOUBLE), -9.5 * 1.1::DOUBLE)', 6)} AS crossed,
    {rnd('least(c_acctbal, max * 1.1::DOUBLE)', 6)} AS open_below
    FROM customer, ({statistics('customer', 'c_acctbal')})"""
SQL["nan_repair"] = f"""SELECT c_custkey, {rnd('''CASE c_custkey % 4 WHEN 0 THEN mean_nonzero WHEN 1 THEN max
      WHEN 2 THEN min ELSE c_acctbal END''', 6)} AS repaired, c_custkey % 4 = 1 AS too_high
    FROM customer, ({statistics('customer', 'c_acctbal')})"""

# --- end to end --------------------------------------------------------------


def cholesky(d_: int) -> list[str]:
    """Chained CTEs: row i of the factor from the rows before it."""
    out, before = [], "correlation"
    for i in range(d_):
        cells = []
        for j in range(i):
            inner = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            cells.append(f"(rho_{j}_{i}{inner}) / l_{j}_{j} AS l_{i}_{j}")
        squares = "".join(f" - l_{i}_{j} * l_{i}_{j}" for j in range(i))
        cells.append(f"sqrt(1::DOUBLE{squares}) AS l_{i}_{i}")
        out.append(f"factor_{i} AS (SELECT *, {', '.join(cells)} FROM {before})")
        before = f"factor_{i}"
    return out


def moved_shape(i: int, family: str) -> str:
    """The shape after widening; any valid one if the column has another law."""
    shape = {"beta": "a", "gamma": "shape", "chi2": "df"}[family]
    if family == "chi2":
        return f"greatest(trunc(coalesce(law_{i}.df, 2) * g_{i}), 1) / 2::DOUBLE"
    return f"greatest(coalesce(law_{i}.{shape}, 2) * g_{i}, 1e-6)"


def curve(i: int, family: str) -> list[str]:
    """CTEs that integrate one law's density for every block's shape."""
    k = moved_shape(i, family)
    if family == "beta":
        ends = "-24 / k AS low, 24 / k AS high"
        f, slope = "exp(-k * ln(1 + exp(-t)) - k * ln(1 + exp(t)))", "k"
    else:
        ends = "(ln(1e-13) + lgamma(k + 1)) / k AS low, ln(k + 12 * sqrt(k) + 40) AS high"
        f, slope = "exp(k * (t - ln(k)) - (exp(t) - k))", "k"
    part = "PARTITION BY k ORDER BY j"
    return [
        f"shapes_{i} AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k) AS no, {ends}"
        f" FROM (SELECT DISTINCT {k} AS k FROM values_of, law_{i}))",
        f"grid_{i} AS (SELECT k, j, low + j * (high - low) / {CURVE_STEPS} AS t,"
        f" (high - low) / {CURVE_STEPS} AS h FROM shapes_{i}, range({CURVE_STEPS} + 1) r(j))",
        f"sums_{i} AS (SELECT k, j, t, h, f, sum(f) OVER ({part}) AS s, first_value(f) OVER ({part}) AS f0"
        f" FROM (SELECT *, {f} AS f FROM grid_{i}))",
        f"mass_{i} AS (SELECT k, j, t, f0 / {slope} + h * (s - (f0 + f) / 2) AS m FROM sums_{i})",
        f"cdf_{i} AS MATERIALIZED (SELECT no + p AS spot, t, p, lead(t) OVER ({part}) AS t2, lead(p) OVER ({part}) AS p2"
        f" FROM (SELECT *, m / max(m) OVER (PARTITION BY k) AS p FROM mass_{i} JOIN shapes_{i} USING (k)))",
    ]


CURVE_STEPS = 4_000  # a Halley step follows


def refined(i: int, family: str) -> str:
    """A CTE with ln x (gamma) or logit x (beta) of every row, from the looked-up segments."""
    near = (f"SELECT s.id, s.in_level, s.k, s.u, c.t + (s.u - c.p) / (c.p2 - c.p) * (c.t2 - c.t) AS t"
            f" FROM spots_{i} s JOIN cdf_{i} c ON s.at_spot = c.spot WHERE s.id IS NOT NULL")
    if family == "beta":
        y = "(1 / (1 + exp(abs(t))))"
        parts = (f"{beta_sum('k', 'k', 'y', 120)} AS p, exp(k * ln(y) + k * ln(1 - y) - 2 * lgamma(k) + lgamma(2 * k)) AS w")
        step = nearer("CASE WHEN t <= 0 THEN p - u ELSE (1 - u) - p END", "w",
                      "k - 2 * k * CASE WHEN t <= 0 THEN y ELSE 1 - y END")
        near = f"SELECT *, {y} AS y FROM ({near})"
    else:
        step, parts = gamma_step("k", "u")
        parts = parts.replace(", u AS u", "")
    return (f"near_{i} AS MATERIALIZED ({near}), "
            f"found_{i} AS MATERIALIZED (SELECT id, in_level, {step} AS t FROM (SELECT *, {parts} FROM near_{i}))")



def generated(table: str, keys, modelled, discrete, levels, copula=True, digits: int | None = 3,
              tabled=(), before: str = "", block: int = BLOCK) -> str:
    """A synthetic table: laws, scores, factor, draws, values; closed forms only."""
    n = len(modelled)
    moving = max(levels) > 0
    ctes = [before] if before else []
    ctes.append(f"fit AS MATERIALIZED (SELECT * FROM {table})")
    for i, c in enumerate(modelled):
        ctes.append(f"law_{i} AS MATERIALIZED ({chosen(table, c, 'fit')})")
    for i, c in enumerate(discrete):
        ctes.append(f"shares_{i} AS MATERIALIZED ({cumulated('fit', c)})")
        ctes.append(f"zero_{i} AS MATERIALIZED ({statistics(table, c)})")
    rho = ", ".join(f"corr(z_{i}, z_{j}) AS rho_{i}_{j}" for i in range(n) for j in range(i + 1, n))
    ctes.append(f"scores AS MATERIALIZED ({scores('fit', modelled)})")
    ctes.append(f"correlation AS (SELECT {rho} FROM scores)")
    ctes += cholesky(n)
    values = ", ".join(f"({d(x)})" for x in levels)
    ctes.append(
        f"ids AS (SELECT range AS id, range // {block} AS block, in_level"
        f" FROM range((SELECT count(*) FROM {table})), (VALUES {values}) levels(in_level))"
    )
    limit = 4.753424308817089
    if copula:
        polar = ", ".join(
            f"sqrt({d(-2.0)} * ln({uniform(f'copula/{i}/r', 'id')})) AS r_{i},"
            f" {uniform(f'copula/{i}/a', 'id')} * {d(2 * 3.141592653589793)} AS a_{i}"
            for i in range((n + 1) // 2)
        )
        normals = ", ".join(
            f"r_{i // 2} * {'cos' if i % 2 == 0 else 'sin'}(a_{i // 2}) AS e_{i}" for i in range(n)
        )
        mixed = ", ".join(
            f"least(greatest({' + '.join(f'l_{i}_{j} * e_{j}' for j in range(i + 1))}, {d(-limit)}), {d(limit)}) AS z_{i}"
            for i in range(n)
        )
        ctes += [
            f"polar AS (SELECT *, {polar} FROM ids)",
            f"normals AS (SELECT *, {normals} FROM polar)",
            f"mixed AS (SELECT id, block, in_level, {mixed} FROM normals, factor_{n - 1})",
            "percentiles AS (SELECT *, {} FROM mixed)".format(
                ", ".join(f"{cdf(f'z_{i}')} AS u_{i}" for i in range(n))),
        ]
    else:
        us = ", ".join(
            f"{between(uniform(f'{c}/u', 'id'), d(0.001), d(0.999))} AS u_{i}" for i, c in enumerate(modelled)
        )
        ctes += [
            f"independent AS (SELECT *, {us} FROM ids)",
            "percentiles AS (SELECT *, {} FROM independent)".format(
                ", ".join(f"{inverse(f'u_{i}')} AS z_{i}" for i in range(n))),
        ]
    out = ["id"] + (["in_level"] if len(levels) > 1 else [])
    joins = []
    shown = {}
    key = "values_of.id" if tabled else "id"
    for i, c in enumerate(modelled):
        g = factor(f"{c}/g", "block", "in_level") if moving else "1::DOUBLE"
        law = f"law_{i}"
        loc, scale = f"({law}.loc * g_{i})", f"greatest({law}.scale * g_{i}, 1e-6)"
        s = f"greatest({law}.s * g_{i}, 1e-6)"
        x = f"""CASE {law}.family WHEN 'uniform' THEN {loc} + {scale} * u_{i}
          WHEN 'normal' THEN {loc} + {scale} * z_{i} WHEN 'lognormal' THEN {scale} * exp({s} * z_{i})
          WHEN 'exponential' THEN -{scale} * ln(1 - u_{i})
          WHEN 'beta' THEN {loc} + {scale} * (0.5 - sin(asin(1 - 2 * u_{i}) / 3)) END"""
        if c in tabled:
            t = f"(cdf_{i}.t)"
            found = {"beta": f"{loc} + {scale} / (1 + exp(-{t}))", "gamma": f"{scale} * exp({t})",
                     "chi2": f"2 * exp({t})"}[tabled[c]]
            x = f"CASE WHEN {law}.family = '{tabled[c]}' THEN {found} ELSE {x} END"
        x = f"least(greatest({x}, {law}.min * 0.9::DOUBLE), {law}.max * 1.1::DOUBLE)"
        x = f"CASE WHEN {law}.zero_ratio > 0.01 AND {uniform(f'{c}/zero', key)} < {law}.zero_ratio THEN 0 ELSE {x} END"
        shown[c] = x
        joins.append(law)
        ctes.append(f"moved_{i} AS (SELECT *, {g} AS g_{i} FROM {'percentiles' if i == 0 else f'moved_{i - 1}'})")
    for i, c in enumerate(discrete):
        u = uniform(f"{c}/category", key)
        shown[c] = (
            f"coalesce((SELECT min(value) FROM shares_{i} WHERE {u} < cum), (SELECT max(value) FROM shares_{i}))"
        )
    order = [c for c in NUMERIC.get(table, DERIVED_COLUMNS) if c in shown]
    out += [f"{rnd(shown[c], digits) if digits is not None else shown[c]} AS {c}" for c in order]
    source = f"moved_{n - 1}"
    if tabled:
        ctes.append(f"values_of AS MATERIALIZED (SELECT * FROM {source})")
        source = f"values_of, {', '.join(joins)}"
        for i, c in enumerate(modelled):
            if c in tabled:
                ctes += curve(i, tabled[c])
                shape = moved_shape(i, tabled[c])
                ctes.append(
                    f"step_{i} AS MATERIALIZED (SELECT id, in_level, k, u, no + u AS spot FROM (SELECT values_of.id,"
                    f" values_of.in_level, {shape} AS k, u_{i} AS u FROM values_of, law_{i})"
                    f" JOIN shapes_{i} USING (k))"
                )
                ctes.append(
                    f"spots_{i} AS MATERIALIZED (SELECT id, in_level, k, u, spot, max(CASE WHEN id IS NULL THEN spot END)"
                    " OVER (ORDER BY spot, id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS at_spot FROM ("
                    f"SELECT NULL AS id, NULL AS in_level, NULL AS k, NULL AS u, spot FROM cdf_{i} UNION ALL"
                    f" SELECT id, in_level, k, u, spot FROM step_{i}))"
                )
                ctes.append(refined(i, tabled[c]))
        # the refined points under the names the value expressions use
        for i, c in enumerate(modelled):
            if c in tabled:
                source += f" , found_{i} AS cdf_{i}"
        same = " AND ".join(
            f"values_of.id = cdf_{i}.id AND values_of.in_level = cdf_{i}.in_level"
            for i, c in enumerate(modelled) if c in tabled
        )
        out = [f"values_of.{x}" if x in ("id", "in_level") else x for x in out]
        return f"WITH {', '.join(ctes)} SELECT {', '.join(out)} FROM {source} WHERE {same}"
    return f"WITH {', '.join(ctes)} SELECT {', '.join(out)} FROM {source}, {', '.join(joins)}"


CUSTOMER = ("customer", ["c_custkey"], NUMERIC["customer"], [])
SQL["generate_customer"] = generated(*CUSTOMER, [0.0])
SQL["generate_customer_sweep"] = generated(*CUSTOMER, LEVELS)
SQL["generate_customer_independent"] = generated(*CUSTOMER, [0.1], copula=False)
SQL["generate_orders"] = generated("orders", ["o_orderkey"], NUMERIC["orders"], [], [0.1])
SQL["generate_lineitem"] = generated(
    "lineitem", LINEITEM_KEY, MODELLED, ["l_linenumber", "l_tax"], [0.0]
)


def summary(source: str, groups, digits: dict[str, int]) -> str:
    cells = ", ".join(
        f"{rnd(f'avg({c})', n)} AS avg_{c}, {rnd(f'stddev_pop({c})', n)} AS std_{c}"
        for c, n in digits.items()
    )
    by = ", ".join(groups)
    return f"SELECT {by}, count(*) AS n_rows, {cells} FROM ({source}) GROUP BY {by}"


SQL["generate_lineitem_summary"] = summary(
    generated("lineitem", LINEITEM_KEY, MODELLED, ["l_linenumber", "l_tax"], [0.1], digits=None,
              tabled={"l_discount": "beta"}, block=10_000),
    ["l_tax"], {"l_orderkey": 3, "l_quantity": 5, "l_extendedprice": 2, "l_discount": 6},
)
SKEWED = ["frac", "expo", "lognorm", "erlang4", "heavy"]
SQL["generate_derived_summary"] = summary(
    generated("derived", ["o_orderkey"], SKEWED, ["disc"], [0.0, 0.1], digits=None,
              tabled={"frac": "beta", "lognorm": "gamma", "erlang4": "gamma", "heavy": "chi2"},
              before=f"derived AS MATERIALIZED {DERIVED}", block=1000),
    ["in_level", "disc"], dict.fromkeys(SKEWED, 3),
)
SQL["generate_skewed"] = generated(
    "derived", ["o_orderkey"], SKEWED, ["disc"], [0.0, 0.1], digits=4,
    tabled={"frac": "beta", "lognorm": "gamma", "erlang4": "gamma", "heavy": "chi2"},
    before=f"derived AS MATERIALIZED {DERIVED}", block=1000)
SQL["generate_lineitem_fuzzed"] = generated(
    "lineitem", LINEITEM_KEY, MODELLED, ["l_linenumber", "l_tax"], [0.1], tabled={"l_discount": "beta"})
SQL["generate_sampled"] = f"""WITH law AS (SELECT avg(o_totalprice) AS loc,
      stddev_pop(o_totalprice) * sqrt(0.5::DOUBLE) AS scale, count(*) AS n FROM orders),
    ids AS MATERIALIZED (SELECT range AS id, in_level, {factor('o_totalprice/g', "'0'", 'in_level')} AS g
      FROM range((SELECT n FROM law)), (VALUES ({d(0.0)}), ({d(0.1)})) levels(in_level)),
    drawn AS (SELECT in_level, loc * g + greatest(scale * g, 1e-6) * (ln(a) - ln(b)) AS x FROM law, (
      SELECT in_level, g, {uniform('o_totalprice/pool/0/a', 'id')} AS a,
        {uniform('o_totalprice/pool/0/b', 'id')} AS b FROM ids UNION ALL
      SELECT in_level, g, {uniform('o_totalprice/pool/1/a', 'id')} AS a,
        {uniform('o_totalprice/pool/1/b', 'id')} AS b FROM ids)),
    pool AS (SELECT in_level, x, row_number() OVER (PARTITION BY in_level ORDER BY x) - 1 AS spot FROM drawn),
    wanted AS (SELECT id, in_level, floor({between(uniform('o_totalprice/u', 'id'), d(0.001), d(0.999))}
      * (2 * n - 1))::BIGINT AS spot FROM ids, law)
    SELECT id, in_level, {rnd('x', 3)} AS o_totalprice FROM wanted JOIN pool USING (in_level, spot)"""
SQL["generate_density"] = f"""WITH law AS (SELECT avg(o_totalprice) AS loc, count(*) AS n, min(o_totalprice) AS low,
      max(o_totalprice) AS high, stddev_pop(o_totalprice) * sqrt(3::DOUBLE) / pi() AS scale FROM orders),
    ids AS (SELECT range AS id, range // {BLOCK} AS block, in_level
      FROM range((SELECT n FROM law)), (VALUES ({d(0.0)}), ({d(0.1)})) levels(in_level)),
    drawn AS (SELECT id, in_level, {factor('o_totalprice/g', 'block', 'in_level')} AS g,
      {between(uniform('o_totalprice/u', 'id'), d(0.001), d(0.999))} AS u FROM ids)
    SELECT id, in_level, {rnd('least(greatest(loc * g + greatest(scale * g, 1e-6) * ln(u / (1 - u)),'
                              ' low * 0.9::DOUBLE), high * 1.1::DOUBLE)', 1)} AS o_totalprice FROM drawn, law"""
SQL["csv_sweep_roundtrip"] = f"""SELECT in_level, count(*) AS n_rows,
    {', '.join(f"{rnd(f'avg({c})', 3)} AS avg_{c}" for c in NUMERIC['customer'])}
    FROM ({generated(*CUSTOMER, LEVELS, digits=None)}) GROUP BY in_level"""
SQL["csv_roundtrip"] = f"""SELECT o_orderstatus, count(*) AS n_rows, max(o_orderkey) AS max_key,
    {rnd('sum(o_totalprice)', 2)} AS total, max(year(o_orderdate)) AS last_year,
    (SELECT string_agg(kind, ',' ORDER BY place) FROM (VALUES
      (1, CASE WHEN (SELECT max(o_orderkey) FROM orders) < 2147483648 THEN 'int' ELSE 'bigint' END),
      (2, CASE WHEN (SELECT max(o_custkey) FROM orders) < 2147483648 THEN 'int' ELSE 'bigint' END),
      (3, 'string'), (4, 'double'), (5, 'timestamp'), (6, 'string')) t(place, kind)) AS types
    FROM orders GROUP BY o_orderstatus"""
SQL["generate_files"] = f"""SELECT in_level, 1::BIGINT AS files, n AS n_rows,
    'synthetic_IN_' || format('{{:.3f}}', in_level) || '_size_' || n || '.csv' AS filename
    FROM (SELECT count(*) AS n FROM customer), (VALUES {', '.join(f"({d(x)})" for x in LEVELS)}) t(in_level)"""

# --- run logs ----------------------------------------------------------------

RUNS = """(SELECT l_linenumber * 100000::BIGINT AS size, l_quantity / 10 AS spark_time,
    CASE WHEN l_linenumber > 5 THEN NULL ELSE l_extendedprice / 1000 END AS seq_time FROM lineitem)"""
SQL["run_summary"] = f"""SELECT size, {rnd('avg(spark_time)', 6)} AS spark_mean,
    {rnd('stddev_samp(spark_time)', 6)} AS spark_std, {rnd('avg(seq_time)', 6)} AS seq_mean,
    {rnd('stddev_samp(seq_time)', 6)} AS seq_std FROM {RUNS} GROUP BY size"""
SQL["speedup"] = f"""SELECT size, {rnd('avg(seq_time) / avg(spark_time)', 6)} AS speedup
    FROM {RUNS} GROUP BY size"""
TWO_PHASE = """(SELECT size, avg(train_time) AS train_mean, stddev_samp(train_time) AS train_std,
    avg(sample_time) AS sample_mean, stddev_samp(sample_time) AS sample_std,
    avg(train_time) + avg(sample_time) AS total_mean,
    sqrt(var_samp(train_time) + var_samp(sample_time)) AS total_std
    FROM (SELECT l_linenumber * 100000::BIGINT AS size,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 10 END AS train_time,
      CASE WHEN l_linenumber > 5 THEN NULL ELSE l_extendedprice / 1000 END AS sample_time FROM lineitem)
    GROUP BY size)"""
_phases = [f"{p}_{k}" for p in ("train", "sample", "total") for k in ("mean", "std")]
SQL["two_phase_summary"] = (
    f"SELECT size, {', '.join(f'{rnd(c, 6)} AS {c}' for c in _phases)} FROM {TWO_PHASE}"
)


def _text(phase: str, missing: str, title: str) -> str:
    return (
        f"CASE WHEN {phase}_mean IS NULL THEN '{missing}' ELSE printf('%.2f', {phase}_mean) || ' ± ' ||"
        f" coalesce(printf('%.2f', {phase}_std), 'nan') END AS \"{title}\""
    )


SQL["two_phase_presentation"] = f"""SELECT format('{{:,}}', size) AS "Sample Size",
    {_text('train', 'N/A', 'Train Time (s)')}, {_text('sample', 'N/A (OOM)', 'Sample Time (s)')},
    {_text('total', 'N/A (OOM)', 'Total Time (s)')} FROM {TWO_PHASE}"""
SQL["level_log"] = f"""SELECT count(*) AS files, {rnd('sum(o_totalprice / 1000)', 3)} AS total_time,
    {rnd('avg(o_totalprice / 1000)', 6)} AS average_time FROM orders"""
